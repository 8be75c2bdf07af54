"""Column functions: keys, hashes, names and stamps."""
