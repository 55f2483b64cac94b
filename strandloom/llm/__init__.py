"""Operators for training-data pipelines over text and pair data; nothing else in the library imports this package."""
