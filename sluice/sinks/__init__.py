"""Writing typed tables."""
