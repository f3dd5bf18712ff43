"""Operators of a training-data pipeline: scores, personal data, tokens, fingerprints and near copies."""
