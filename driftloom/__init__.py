"""A PySpark-native engine for web-document corpora and training data."""
