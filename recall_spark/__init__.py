"""Spark-native analytics over large archives of conversations and documents."""
