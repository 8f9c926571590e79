"""Training-data operators: packing, archives, near duplicates, privacy, quality and token accounting."""
