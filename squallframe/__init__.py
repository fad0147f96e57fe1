"""Storm exposure and disaster-loss attribution as Spark DataFrame operators."""
