"""Document text processing and its analytics as Spark DataFrame operators."""
