"""Jobs: read, apply operators, write."""
