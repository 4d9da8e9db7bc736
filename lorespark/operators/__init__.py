"""Operators over DataFrames: retrieval, document lifecycle, access and lists."""
