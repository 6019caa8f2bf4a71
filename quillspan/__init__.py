"""Annotated-text-corpus analytics expressed as Spark DataFrames."""
