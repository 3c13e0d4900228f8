"""Column expressions and vectorized functions."""
