"""A PySpark-native engine for staged text analytics over forum posts."""

__version__ = "0.1.0"
