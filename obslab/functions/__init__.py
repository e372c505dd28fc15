"""Column expressions: text clean-up, identity hashes, display formats."""
