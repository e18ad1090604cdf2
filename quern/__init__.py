"""quern: a PySpark-native code-and-corpus analytics library."""

__version__ = "0.1.0"
