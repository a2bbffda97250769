"""Personal-timeline analytics as Spark DataFrame plans."""
