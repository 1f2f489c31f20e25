"""Concept-graph and text analytics on Spark."""
