"""Operators for training data: runs, percentiles, packing, mixing, truncation. Nothing outside imports this."""
