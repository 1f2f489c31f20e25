"""Relational operators over graphs, chunks, rules and metrics."""
