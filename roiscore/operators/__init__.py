"""Operators on tables of windows, regions and pixels."""
