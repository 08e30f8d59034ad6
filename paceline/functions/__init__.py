"""Column functions: strings, times, sizes."""
