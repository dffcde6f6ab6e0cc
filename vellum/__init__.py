"""Versioned, multi-witness text analytics on Spark DataFrames."""
