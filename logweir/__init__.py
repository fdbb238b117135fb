"""logweir: a PySpark-native analytics engine for heterogeneous log data."""

__version__ = "0.1.0"
