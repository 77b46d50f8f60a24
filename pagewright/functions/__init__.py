"""Column functions: geometry, text and formats."""
