"""Column profile, type decision, typed projection and line parsing."""
