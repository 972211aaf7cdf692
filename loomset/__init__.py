"""A PySpark-native engine for curating, validating and scoring multi-turn issue-resolution datasets."""
