"""Spark-native benchmark curation and retrieval evaluation."""
