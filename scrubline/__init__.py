"""A PySpark-native, recipe-driven data cleaning and data quality engine."""

__version__ = "0.1.0"
