"""Operators from DataFrame to DataFrame."""
