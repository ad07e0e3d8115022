"""Training-data operators: formatting, scoring, deduplication, filtering, packing."""
