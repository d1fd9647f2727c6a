"""Operators on the question bank's tables: DataFrames in, DataFrames out."""
