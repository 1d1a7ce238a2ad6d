"""Spark-native analytics over versioned BIGINT -> BIGINT key-value logs."""
