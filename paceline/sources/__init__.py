"""Reading and writing the wire formats and tables."""
