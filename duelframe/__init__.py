"""Paired-contest analytics as Spark DataFrame jobs."""
