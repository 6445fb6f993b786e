"""Training-data operators: decontamination, counting, deduplication, quality, mixing, toxicity, token output."""
