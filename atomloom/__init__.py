"""atomloom: a PySpark-native engine for retrieval-augmented knowledge bases."""
