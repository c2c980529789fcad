"""A Spark-native engine for vector, map and detection tables."""
