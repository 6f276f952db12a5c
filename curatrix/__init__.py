"""Curation and scoring analytics for large text and embedding collections, built on DataFrames."""

__version__ = "0.1.0"
