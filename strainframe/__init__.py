"""Sequence, strain and ranking analytics expressed as Spark DataFrames."""
