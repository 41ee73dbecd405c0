"""A Spark-native engine for auditing and mining websites."""
