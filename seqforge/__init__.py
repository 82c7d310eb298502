"""A Spark-native engine for evaluating sequence models and sequence features."""
