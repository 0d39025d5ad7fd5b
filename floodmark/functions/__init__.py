"""Column functions: numbers, buckets, states."""
