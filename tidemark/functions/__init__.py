"""Column-level helpers: durations, instants, arrays, step functions."""
