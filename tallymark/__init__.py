"""A Spark-native engine that ranks entities by public evidence."""
