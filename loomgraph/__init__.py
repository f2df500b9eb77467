"""Spark-native engine for building, completing and evaluating knowledge graphs."""
