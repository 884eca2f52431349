"""Spark-native ingest of delimited text into typed Parquet."""
