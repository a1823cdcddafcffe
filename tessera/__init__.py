"""Keyed tables on Spark: a command language, versioned Parquet snapshots, a command log and layout analytics."""
