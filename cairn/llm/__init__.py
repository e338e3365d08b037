"""Training-data operators: deduplication, filtering, scoring, mixing and formatting of text corpora."""
