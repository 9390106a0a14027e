"""glyphlake: a PySpark-native engine for multilingual text conversion."""

__version__ = "0.1.0"
