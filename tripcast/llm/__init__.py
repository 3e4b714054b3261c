"""Corpus operators for training-data pipelines. Optional: nothing else in the package imports this."""
