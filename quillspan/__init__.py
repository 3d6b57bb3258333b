"""PySpark-native analytics for text-centric knowledge bases."""
