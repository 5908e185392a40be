"""Preparing document corpora for retrieval and training on Spark."""
