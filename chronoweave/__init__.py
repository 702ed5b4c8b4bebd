"""Temporal fact selection, question plans, text retrieval and answer scoring as Spark DataFrame operations."""
