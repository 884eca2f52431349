"""Scalar expressions from text to typed values."""
