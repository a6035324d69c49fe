"""Readers, writers and the views that give raw tables the engine's shape."""
