"""A Spark-native engine for image catalogues, vector search and similarity graphs."""
