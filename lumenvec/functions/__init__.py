"""Spark-native building blocks; see README."""
