"""Training-data operators: deduplication, filtering, mixing and scoring of text corpora."""
