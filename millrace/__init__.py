"""Spark-native analytics over wide tables: a compact SQL dialect, CSV/Parquet
ingest and operators for large-scale data preparation."""

__version__ = "0.1.0"
