"""Relational operators over blocks and vectors."""
