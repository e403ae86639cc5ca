"""A PySpark-native engine for organisational knowledge tables and training-data pipelines."""
