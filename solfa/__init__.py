"""Spark-native metadata cleansing, entity resolution and royalty reshaping."""
