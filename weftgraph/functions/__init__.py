"""Scalar functions: text, exact numbers, hashes."""
