"""Operators for training-data pipelines over tables of documents, embeddings and conversations."""
