"""Radio-monitoring analytics as Spark DataFrame operators."""
