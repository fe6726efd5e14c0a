"""Spark-native content-intelligence engine."""
