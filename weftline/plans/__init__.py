"""What to run and in which order: selection, prior state and scheduling order."""
