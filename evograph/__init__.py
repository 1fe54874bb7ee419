"""A PySpark-native engine for software-evolution data."""
