"""A PySpark-native engine for collections of scalar, JSON, array and vector columns."""

__version__ = "0.1.0"
