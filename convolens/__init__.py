"""Spark-native analytics over recorded agent conversations."""
