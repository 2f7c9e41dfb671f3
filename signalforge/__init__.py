"""Spark-native drug-safety signal analytics and training-data operators."""
