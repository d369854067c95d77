"""sluice: a Spark-native analytics engine."""
