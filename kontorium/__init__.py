"""Spark-first engine for contact exports and large training corpora."""
