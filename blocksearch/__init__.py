"""Semantic search over block-structured notes, on PySpark."""
