"""Column functions: JSON paths, templates, typed values, times, hashes, text and sums."""
