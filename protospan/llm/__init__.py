"""Operators for training data: linkage, encoding, mixing and truncation."""
