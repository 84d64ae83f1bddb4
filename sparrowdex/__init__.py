"""Spark-native text retrieval, relevance analytics and corpus preparation."""
