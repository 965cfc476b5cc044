"""Spark-native analytics for missing data, imputation quality, graph learning and group fairness."""
