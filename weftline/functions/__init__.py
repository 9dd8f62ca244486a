"""Functions over SQL text."""
