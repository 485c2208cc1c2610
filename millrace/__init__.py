"""millrace: a PySpark-native dataset and analytics engine for language-model training data."""

__version__ = "0.1.0"
