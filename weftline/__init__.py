"""weftline: a Spark-native retrieve-and-rank analytics engine."""

__version__ = "0.1.0"
