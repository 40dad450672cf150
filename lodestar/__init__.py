"""Lodestar: a small Spark-native analytics engine for star-schema workloads."""
