"""Bulk analysis of long discussion threads on Spark: every operator maps DataFrames to DataFrames."""
