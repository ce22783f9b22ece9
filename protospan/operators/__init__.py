"""Relational and statistical operators: DataFrames in, one lazy DataFrame out."""
