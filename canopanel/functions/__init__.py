"""Column functions: calendar, labels and special functions."""
