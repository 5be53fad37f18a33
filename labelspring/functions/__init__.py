"""Column functions: tokenizers, hashed counts, vectors, scalar formulas."""
