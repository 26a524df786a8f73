"""A PySpark-native engine for web-posting analytics."""

__version__ = "0.1.0"
