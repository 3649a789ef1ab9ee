"""Plans of the retrieval evaluation engine."""
