"""A PySpark-native engine for symbolic-music tokenization and analytics."""
