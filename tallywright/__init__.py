"""PySpark-native auditing of multi-label score matrices."""
