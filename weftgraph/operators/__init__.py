"""Graph operators that are more than one join: variable-length and shortest paths, and writes."""
