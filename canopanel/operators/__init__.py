"""Operators on panels, samples, predictions and grids."""
