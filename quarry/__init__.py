"""Corpus preparation and evaluation for generative retrieval, on Spark DataFrames."""
