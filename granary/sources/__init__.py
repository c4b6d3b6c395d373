"""Table sources and the catalog tables."""
