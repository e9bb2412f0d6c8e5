"""Column expressions: tokens, fingerprints, descriptors, hashing."""
