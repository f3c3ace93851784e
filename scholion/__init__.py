"""Corpus annotation and text-data engine on Spark DataFrames."""
