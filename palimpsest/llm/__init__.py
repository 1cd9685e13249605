"""Training-data operators: token counts, encoding, language, dedup, quality, mixing, fingerprints, toxicity, shards."""
