"""Operators of a training-data pipeline over documents, benchmarks, labels and embeddings.

Nothing outside this package (and `corpus_pipeline.py`) imports it.
"""
