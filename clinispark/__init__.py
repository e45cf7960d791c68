"""Clinical conversation and text analytics as Spark DataFrame operators."""
