"""A PySpark-native engine for evidence graphs built from narrative documents."""
