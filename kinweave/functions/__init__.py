"""Column functions and similarity kernels."""
