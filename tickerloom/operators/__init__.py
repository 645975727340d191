"""Operators over DataFrames: extraction, index, search, recency, frontier, statistics."""
