"""Training-data operators: extraction, deduplication, scoring, filtering and mixing."""
