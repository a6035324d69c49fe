"""Physical-plan helpers: session settings, size checks, skew, ordering."""
