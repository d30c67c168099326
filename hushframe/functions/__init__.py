"""Column functions and name heuristics."""
