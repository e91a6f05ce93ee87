"""Spark-native knowledge-graph, retrieval and corpus operators."""
