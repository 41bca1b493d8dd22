"""Operators: one DataFrame or array column in, one out."""
