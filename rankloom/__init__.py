"""Batch document retrieval and ranking as plain Spark DataFrame jobs."""
