"""Operators for preparing training corpora, as Spark jobs."""
