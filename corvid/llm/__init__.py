"""Training-data operators: deduplication, filtering, tokenizing, packing and search."""
