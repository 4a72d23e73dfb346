"""Incremental upkeep of fact tables. An extension: a batch run gives the same tables."""
