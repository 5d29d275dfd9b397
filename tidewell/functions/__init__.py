"""Column functions: null-safe arithmetic, kinetic models, fit metrics."""
