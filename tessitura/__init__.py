"""Sequence, transcript and corpus analytics on Spark DataFrames."""
