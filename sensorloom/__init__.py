"""A PySpark-native engine for event and signal data from dense sensor arrays."""
