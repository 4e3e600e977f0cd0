"""Spark-native analysis of append-only interaction journals."""
