"""Document search and analytics as Spark DataFrame operators."""
