"""Directed-graph link analytics as Spark DataFrame plans."""
