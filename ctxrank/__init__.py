"""Ranking contexts for retrieval-augmented generation, as lazy Spark plans."""
