"""Column-level building blocks of the dialect."""
