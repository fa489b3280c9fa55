"""Hybrid retrieval over code and document corpora, written as Spark DataFrame jobs."""
