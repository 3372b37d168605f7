"""Claim analytics on Spark: every operator takes and returns DataFrames."""
