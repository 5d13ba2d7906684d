"""Spark-native schedule analytics and corpus preparation."""
