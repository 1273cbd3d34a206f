"""PySpark-native engine for text-recognition evaluation and corpus preparation."""
