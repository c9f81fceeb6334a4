"""A PySpark-native engine for search, ranking and retrieval analytics."""

__version__ = "0.1.0"
