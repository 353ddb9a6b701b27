"""Spark-native analytics over an associative note store: retrieval, graph upkeep, ingestion and data-quality operators."""
