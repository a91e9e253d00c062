"""Training-data operators: scoring, deduplication, tokens, privacy, mixing, quality, shards, archives, media."""
