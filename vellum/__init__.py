"""vellum: a PySpark-native engine for refining messy historical records."""

__version__ = "0.1.0"
