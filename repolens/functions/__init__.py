"""Column functions and per-file parsers."""
