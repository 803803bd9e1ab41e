"""Whole plans over all cases at once."""
