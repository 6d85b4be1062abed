"""A Spark-native engine for priced lists."""
