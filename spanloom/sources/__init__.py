"""Sources of the retrieval evaluation engine."""
