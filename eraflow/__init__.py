"""Panel analytics as Spark DataFrame operators."""
