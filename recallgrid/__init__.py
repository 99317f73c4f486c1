"""recallgrid: long-term-memory analytics as plain Spark DataFrame programs."""
