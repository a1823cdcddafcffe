"""Request generators of the key-value workloads: column expressions, and wrapping arithmetic on the driver."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

THETA = 0.99
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3
ALPHANUMERIC = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def make_key(i: Column) -> Column:
    """user and ten digits."""
    return F.format_string("user%010d", i)


def zeta(n: int, theta: float = THETA) -> float:
    return sum(1.0 / i**theta for i in range(1, n + 1))


def zipf_rank(u: Column, n: int, theta: float = THETA) -> Column:
    """A rank from 0 to n - 1 for a uniform draw in [0, 1), by the closed-form inverse of Gray and others (1994)."""
    z = zeta(n, theta)
    alpha = 1 / (1 - theta)
    eta = (1 - (2 / n) ** (1 - theta)) / (1 - zeta(2, theta) / z)
    tail = F.floor(n * F.pow(eta * u - eta + 1, F.lit(alpha)))
    return F.least(F.when(u * z < 1, 0).when(u * z < 1 + 0.5**theta, 1).otherwise(tail).cast("bigint"), F.lit(n - 1))


def latest_rank(u: Column, inserted: int) -> Column:
    """The newest keys most often."""
    return F.lit(inserted - 1) - zipf_rank(u, inserted)


def scramble(rank: int, n: int) -> int:
    """FNV-1a of the rank's eight bytes, mod n: needs multiplication that wraps, so it is made on the driver."""
    h = FNV_OFFSET
    for b in rank.to_bytes(8, "little"):
        h = ((h ^ b) * FNV_PRIME) & ((1 << 64) - 1)
    return h % n


def scrambled(ranks: list[int], n: int) -> list[int]:
    return [scramble(r, n) for r in ranks]


def fields(seed: int, count: int = 10, size: int = 100) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choices(ALPHANUMERIC, k=size)) for _ in range(count)]


def records(spark: SparkSession, n: int, count: int = 10, size: int = 100, seed: int = 42) -> DataFrame:
    """key and field0 .. fieldN with seeded characters, made on the executors: repeated digests cut to size."""
    text = lambda f: F.substring(F.concat(*[F.sha2(F.concat_ws(":", F.lit(seed), "id", F.lit(f), F.lit(k)), 256) for k in range(-(-size // 64))]), 1, size)
    return spark.range(n).select(make_key(F.col("id")).alias("key"), *[text(f).alias(f"field{f}") for f in range(count)])


#: Shares of read, update, insert, scan and read-modify-write, and the choice of keys.
WORKLOADS = {
    "A": ({"read": 50, "update": 50}, "zipf"),
    "B": ({"read": 95, "update": 5}, "zipf"),
    "C": ({"read": 100}, "zipf"),
    "D": ({"read": 95, "insert": 5}, "latest"),
    "E": ({"scan": 95, "insert": 5}, "zipf"),
    "F": ({"read": 50, "rmw": 50}, "zipf"),
}


def requests(spark: SparkSession, workload: str, ops: int, inserted: int, seed: int = 123, longest_scan: int = 100) -> DataFrame:
    """(pos, op, id, length): one row per request. Inserts get new ids in order of position."""
    shares, choice = WORKLOADS[workload]
    base = spark.range(ops).select(F.col("id").alias("pos"), F.rand(seed).alias("u"), F.rand(seed + 1).alias("v"), F.rand(seed + 2).alias("w"))
    op, low = F.lit(None).cast("string"), 0
    for name, share in shares.items():
        op = F.when((F.col("u") * 100 >= low) & (F.col("u") * 100 < low + share), name).otherwise(op)
        low += share
    rank = latest_rank(F.col("v"), inserted) if choice == "latest" else zipf_rank(F.col("v"), inserted)
    if choice == "zipf":  # a fixed permutation spreads popular ranks over the key space
        rank = F.pmod(F.xxhash64(rank), F.lit(inserted))
    return base.select("pos", op.alias("op"), F.when(op == "insert", F.lit(inserted) + F.col("pos")).otherwise(rank).alias("id"), (F.floor(F.col("w") * longest_scan) + 1).cast("int").alias("length"))
