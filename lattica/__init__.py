"""Hierarchical statistics on labelled graphs, as Spark DataFrame operations."""
