"""siltstone: Spark-native corpus, retrieval and measurement analytics."""
