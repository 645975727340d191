"""PySpark-native record extraction and ranked search."""
