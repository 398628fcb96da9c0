"""Spark-native analytics over document collections: retrieval, graphs, routing and evaluation as DataFrame plans."""
