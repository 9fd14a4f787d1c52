"""Curation and benchmark analytics as Spark DataFrame jobs."""
