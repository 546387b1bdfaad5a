"""Spark jobs for live-cell imaging and single-cell sequencing experiments."""
