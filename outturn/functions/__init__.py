"""Column-level building blocks: vocabularies, patterns, text and rank helpers."""
