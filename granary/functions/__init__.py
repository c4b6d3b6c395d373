"""Column functions with the dialect's own semantics."""
