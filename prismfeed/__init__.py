"""Spark-first analytics for multi-outlet news corpora."""
