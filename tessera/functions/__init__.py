"""Column functions: Hangul arithmetic, text normalisation, tag maps, costs and hashes."""
