"""A PySpark-native data-quality analytics engine."""
