"""Device-incident analytics as Spark DataFrame operators."""
