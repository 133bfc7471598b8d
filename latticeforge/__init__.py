"""Concept mining and rule induction over Spark DataFrames."""
