"""Operators for training-data pipelines: documents in, decisions and digests out."""
