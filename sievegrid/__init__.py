"""Spark-native analytics over the inputs and results of source-code security scans."""
