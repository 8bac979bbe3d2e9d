"""Column functions over ordered series."""
