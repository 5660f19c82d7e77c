"""Operators for training data: documents, pages, embeddings and conversations."""
