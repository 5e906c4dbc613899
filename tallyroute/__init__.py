"""Site traffic analytics as lazy Spark DataFrame transformations."""
