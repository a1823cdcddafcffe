"""Key-range shards: routing of keys and ranges, and scatter-gather in key order.

A shard owns lo <= key < hi; a null bound is open. The shard table has a row per server and is made by the
driver from a configuration, so it is broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.keys import hex_bound


@dataclass(frozen=True)
class Shard:
    host: str
    port: int
    lo: bytes | None
    hi: bytes | None

    def owns(self, key: bytes) -> bool:
        return (self.lo is None or key >= self.lo) and (self.hi is None or key < self.hi)

    def overlaps(self, lo: bytes, hi: bytes) -> bool:
        """Whether the closed range [lo, hi] meets it."""
        return lo <= hi and (self.hi is None or lo < self.hi) and (self.lo is None or hi >= self.lo)


def parse_config(text: str) -> list[Shard]:
    """Lines of host, port, lo and hi in hex, - for an open end."""
    out = []
    for line in text.splitlines():
        if parts := line.split():
            host, port, lo, hi = parts
            out.append(Shard(host, int(port), hex_bound(lo), hex_bound(hi)))
    return sorted(out, key=lambda s: s.lo or b"")


def route_key(shards: list[Shard], key: bytes) -> int | None:
    return next((i for i, s in enumerate(shards) if s.owns(key)), None)


def route_range(shards: list[Shard], lo: bytes, hi: bytes) -> list[int]:
    return [i for i, s in enumerate(shards) if s.overlaps(lo, hi)]


def shard_frame(spark: SparkSession, shards: list[Shard]) -> DataFrame:
    return spark.createDataFrame([(i, bytearray(s.lo) if s.lo is not None else None, bytearray(s.hi) if s.hi is not None else None) for i, s in enumerate(shards)], "shard int, lo binary, hi binary")


def shard_of(key: Column, shards: list[Shard]) -> Column:
    """The owning shard as an expression without a join: one comparison for each boundary."""
    out = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(shards))):
        owns = F.lit(True)
        if s.lo is not None:
            owns = owns & (key >= F.lit(bytearray(s.lo)))
        if s.hi is not None:
            owns = owns & (key < F.lit(bytearray(s.hi)))
        out = F.when(owns, i).otherwise(out)
    return out


def route_ranges(ranges: DataFrame, shards: list[Shard], lo: str, hi: str) -> DataFrame:
    """A row for each range and shard that meet; no join, as the shards are a literal."""
    each = F.array(*[
        F.when((F.col(lo) <= F.col(hi)) & (F.lit(True) if s.hi is None else F.col(lo) < F.lit(bytearray(s.hi))) & (F.lit(True) if s.lo is None else F.col(hi) >= F.lit(bytearray(s.lo))), i)
        for i, s in enumerate(shards)
    ])
    return ranges.withColumn("shard", F.explode(F.array_compact(each)))


def scatter_gather(df: DataFrame, key: Column, shards: list[Shard]) -> DataFrame:
    """Rows per shard, with the total beside; one pass."""
    return df.groupBy(shard_of(key, shards).alias("shard")).agg(F.count("*").alias("n"))
