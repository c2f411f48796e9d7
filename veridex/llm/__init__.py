"""Training-data operators: tokens, language, quality, toxicity, duplicates and contamination."""
