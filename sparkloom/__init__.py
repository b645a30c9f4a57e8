"""A PySpark-native engine for corpus extraction, chunking, indexing and retrieval."""
