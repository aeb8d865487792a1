"""Flow reliability analytics as Spark DataFrame operators."""
