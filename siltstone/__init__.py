"""Siltstone: corpus curation, mining and evaluation as declarative Spark plans."""
