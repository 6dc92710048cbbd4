"""Spark-native knowledge-graph analytics over text collections."""
