"""Training-data pipeline operators: formatting, packing, filtering, deduplication and token output."""
