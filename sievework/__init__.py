"""Sievework: dataset-curation analytics on Spark."""
