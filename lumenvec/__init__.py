"""Spark-native operators on embedding vectors, detections and a small identity catalogue."""
