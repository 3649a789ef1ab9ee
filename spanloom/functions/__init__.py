"""Functions of the retrieval evaluation engine."""
