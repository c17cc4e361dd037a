"""Spark-native analytics for document retrieval: DataFrame in, DataFrame out."""
