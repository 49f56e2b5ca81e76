"""Structured Streaming counterparts of the cache's and the collections' behaviour over time."""
