"""Persistent caches of tokens and embeddings."""
