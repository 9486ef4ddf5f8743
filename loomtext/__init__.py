"""loomtext: a PySpark-native analytics engine for code and text corpora."""
