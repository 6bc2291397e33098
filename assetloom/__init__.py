"""Spark-native curation of large collections of items (images, texts, any keyed rows)."""
