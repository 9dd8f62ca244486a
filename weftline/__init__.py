"""weftline: a Spark-native engine for projects of templated SQL models."""

__version__ = "0.1.0"
