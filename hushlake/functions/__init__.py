"""Column expressions: keyed hashes, tokens, ciphertexts, text."""
