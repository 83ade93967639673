"""Column functions on bytes."""
