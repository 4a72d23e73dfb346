"""Compositions: input adapters, written tables, reports and registered queries."""
