"""Column expressions: parsing, binning, match keys, hashing and distribution tails."""
