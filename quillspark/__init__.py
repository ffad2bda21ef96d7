"""A Spark-native engine that turns text columns into features and cleans training data."""
