"""Spark-native plot imagery analytics."""
