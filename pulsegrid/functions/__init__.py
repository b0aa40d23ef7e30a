"""Column expressions and small numerical kernels."""
