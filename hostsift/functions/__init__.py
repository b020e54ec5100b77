"""Column functions: URL normalisation and parsing, hashing, features."""
