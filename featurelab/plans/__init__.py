"""Fixtures built from the driver tables and the query catalogue."""
