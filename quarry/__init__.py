"""Quarry: analytics over document corpora on Spark DataFrames."""
