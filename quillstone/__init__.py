"""A Spark-native engine for document and receipt analysis."""
