"""Column-level building blocks: parsing, time, names, money arithmetic."""
