"""Semantic-model audit engine on Spark DataFrames."""
