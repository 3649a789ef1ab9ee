"""Operators of a training-data pipeline: filters, joins, shards, mixtures and encoders over documents and pages."""
