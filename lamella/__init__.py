"""lamella: a PySpark-native toolkit for columnar files, their schemas and their values."""

__version__ = "0.1.0"
