"""Queries over the supplied tables, one module per family."""
