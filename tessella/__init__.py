"""Spark-native analytics over documents, holdings, fundamentals, graphs and event streams."""
