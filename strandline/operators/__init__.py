"""Operators over DataFrames of nodes and edges."""
