"""Fleet capacity analytics as Spark DataFrame operators."""
