"""Training-data operators: deduplication, scoring, tokenising and packing of documents."""
