"""PySpark-native analytics engine for public-records data."""
