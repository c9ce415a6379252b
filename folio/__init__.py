"""folio: a Spark-native engine that turns document collections into a clean, quality-graded text library."""

__version__ = "0.1.0"
