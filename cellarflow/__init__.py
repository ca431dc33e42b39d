"""cellarflow: a Spark-native engine for interaction logs - ranking, sessions, exactly-once intake, skew-safe statistics."""

__version__ = "0.1.0"
