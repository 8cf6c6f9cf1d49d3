"""Training-data operators: deduplication, mixing, scoring, tokenising, packing and chat formatting."""
