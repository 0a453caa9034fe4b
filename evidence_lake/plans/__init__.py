"""Composed flows and the named queries over the supplied tables."""
