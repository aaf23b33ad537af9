"""Scalar expressions: Columns in, Column out."""
