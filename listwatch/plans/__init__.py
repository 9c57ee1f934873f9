"""Queries over the driver tables, grouped the way the library is."""
