"""Training-data operators: deduplication, filtering, classification, packing, tokenising and vector search."""
