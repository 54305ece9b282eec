"""tallywright: a Spark-native analytics engine for professional-services practice data."""

__version__ = "0.1.0"
