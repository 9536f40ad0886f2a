"""Column functions: cleaning, tokens, fingerprints, vectors."""
