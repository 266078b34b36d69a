"""Column functions: times, paths, numbers."""
