"""A PySpark-native analytics engine for document corpora."""
