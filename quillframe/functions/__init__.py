"""Column functions: arithmetic, arrays, statistics, metrics."""
