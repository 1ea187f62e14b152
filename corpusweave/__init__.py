"""corpusweave: a PySpark-native engine for text corpora and their metrics."""
