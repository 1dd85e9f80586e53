"""mailquarry: PySpark-native data processing for e-mail and URL corpora."""

__version__ = "0.1.0"
