"""Queries over sets of revisions in a version DAG, as Spark DataFrames."""
