"""Spark-native transaction-network analytics."""
