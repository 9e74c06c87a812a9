"""Training-data operators: deduplication, tokenising, classification, filters and packing."""
