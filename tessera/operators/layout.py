"""Physical layout: snapshots sorted by key, so that range reads skip files and row groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of a file, for the number of range partitions.
FILE_ROWS = 4_000_000


def sorted_by_key(df: DataFrame, key: str, rows: int, file_rows: int = FILE_ROWS) -> DataFrame:
    """Range partitions of about ``file_rows``, sorted within: the layout of every base snapshot."""
    return df.repartitionByRange(max(1, -(-rows // file_rows)), key).sortWithinPartitions(key)


def block_numbers(df: DataFrame, by: Column, block_rows: int, name: str = "block") -> DataFrame:
    """Every row's block in key order, as if blocks of ``block_rows`` rows were cut from the sorted table.

    Ranks come from range partitions: counts of partitions before (a row each) and the rank within.
    """
    parts = max(1, min(1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = df.repartitionByRange(parts, by).withColumn("__p", F.spark_partition_id()).persist()  # read twice: partitions must agree
    sizes = ranged.groupBy("__p").agg(F.count("*").alias("__c"))
    before = sizes.select(F.col("__p").alias("__q"), F.coalesce(F.sum("__c").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    rank = F.row_number().over(W.partitionBy("__p").orderBy(by)) - 1 + F.col("__b")
    return ranged.join(before, F.col("__p") == F.col("__q")).withColumn(name, F.floor(rank / F.lit(block_rows)).cast("bigint")).select(*df.columns, name)
