"""paperloom: a PySpark-native analytics engine for scholarly-document libraries."""
