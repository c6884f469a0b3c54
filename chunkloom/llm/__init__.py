"""Training-data operators: extraction, tokenising, filtering, packing, search, deduplication and sharding."""
