"""Operators of a training-data pipeline: documents in, decisions per document out."""
