"""Composed plans: batch build, graph query, turn replay."""
