"""A PySpark-native engine for open lakehouse tables: pinned snapshots, file skipping, gated SQL."""
