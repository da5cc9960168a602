"""A PySpark-native engine for catalogue ingestion, vector search and its quality gates."""
