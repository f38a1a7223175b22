"""Pergamo: document analytics and hybrid search on Spark DataFrames."""
