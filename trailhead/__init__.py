"""A PySpark-native analytics engine for code-and-task intelligence."""
