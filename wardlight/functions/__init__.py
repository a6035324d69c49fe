"""Column expressions shared by the batch and streaming operators."""
