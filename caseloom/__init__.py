"""Spark-native case linkage: blocking, comparison, scoring and grouping of reports as DataFrame plans."""
