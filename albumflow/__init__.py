"""Spark-native operators for large collections of media metadata and text."""
