"""Conditional-model evaluation and corpus preparation as Spark jobs."""
