"""Column functions: hashes, encoded lengths, display."""
