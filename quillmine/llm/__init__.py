"""Training-data operators: deduplication, language, packing, quality, mixing, privacy and secrets."""
