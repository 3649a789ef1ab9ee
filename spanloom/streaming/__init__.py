"""Streaming of the retrieval evaluation engine: an extension, for logs that grow while they are read."""
