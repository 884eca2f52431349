"""Whole conversions."""
