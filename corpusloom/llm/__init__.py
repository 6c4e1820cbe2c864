"""Operators for training-data pipelines at scale. Nothing else in the library imports this subpackage."""
