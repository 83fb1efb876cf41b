"""sparkweft: a PySpark-native engine for code graphs and text collections."""
