"""A Spark-native hybrid document search and corpus-processing engine."""
