"""Spark-native analytics over directed, typed hypergraphs kept as DataFrames."""
