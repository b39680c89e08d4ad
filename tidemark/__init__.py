"""Tidemark: retrieval and text analytics as plain Spark DataFrame plans."""
