"""A PySpark-native engine for cleaning, measuring and preparing large text corpora."""
