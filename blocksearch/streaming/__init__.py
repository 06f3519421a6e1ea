"""Refresh of an index from a stream of blocks."""
