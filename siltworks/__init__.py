"""siltworks: Spark-native analytics over text corpora."""
