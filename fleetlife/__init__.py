"""Fleet reliability analytics on Spark: life histories, labels, features, drift, models."""
