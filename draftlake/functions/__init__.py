"""Column functions and small lookups."""
