"""Operators of a training-data pipeline: packing, near-dedup, tokenizers, quality, language, toxicity."""
