"""Spark-native engine for reconciling supplier payments and preparing text corpora."""
