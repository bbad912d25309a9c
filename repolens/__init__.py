"""A PySpark-native analytics engine for source code as data."""
