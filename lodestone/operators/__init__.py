"""Decoding operators over long-form scores: DataFrames in, DataFrames out."""
