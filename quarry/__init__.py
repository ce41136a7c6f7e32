"""quarry: a PySpark-native engine for listed-company fundamentals."""
