"""Queries over the driver tables with their DuckDB counterparts; importing the modules registers them."""
