"""Spark-native analytics over places, networks and movements."""
