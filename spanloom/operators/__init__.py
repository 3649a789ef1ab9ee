"""Operators of the retrieval evaluation engine."""
