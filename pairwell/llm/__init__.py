"""Training-data operators: language ID, near duplicates, secrets, media, chat, LM scores, mixing, shards, lines, benchmarks, toxicity, turn repair, token alignment."""
