"""receiptlake: Spark-native processing of receipt and spend data."""

__version__ = "0.1.0"
