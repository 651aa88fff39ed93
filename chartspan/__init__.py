"""Corpus-scale clinical-text annotation on Spark DataFrames."""

__version__ = "0.1.0"
