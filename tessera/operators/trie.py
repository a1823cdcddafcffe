"""Prefix-tree analytics: what the shape of a binary tree over the keys would be, as relational plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.functions.keys import floor_log2, key_bits


def chains_active(keys: DataFrame, key: str) -> DataFrame:
    """Number of heavy paths: of the distinct keys (binary), those that no other key extends.

    A key's extensions follow it directly in byte order, so only neighbours are compared. Range partitions are
    sorted on their own, and the last key of each is held against the first of the next non-empty one: no single
    task sorts all keys, and the driver sees two keys per partition.
    """
    k = keys.select(F.col(key).alias("__k")).distinct()
    parts = max(1, min(1000, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    ranged = k.repartitionByRange(parts, "__k").withColumn("__p", F.spark_partition_id())
    over = W.partitionBy("__p").orderBy("__k")
    extended = lambda a, b: F.coalesce(F.substring(b, F.lit(1), F.octet_length(a)) == a, F.lit(False))
    inner = ranged.withColumn("__next", F.lead("__k").over(over)).groupBy("__p").agg(F.count_if(~extended(F.col("__k"), F.col("__next"))).alias("n"), F.min("__k").alias("lo"), F.max("__k").alias("hi"))
    edge = W.orderBy("lo")  # a row for each partition
    return inner.withColumn("__after", F.lead("lo").over(edge)).agg(F.coalesce(F.sum("n") - F.count_if(extended(F.col("hi"), F.col("__after"))), F.lit(0)).cast("bigint").alias("chains"))


def bit_prefixes(keys: DataFrame, key: str) -> DataFrame:
    """(key, depth, prefix) for every proper and full bit prefix of every key."""
    bits = keys.select(F.col(key).alias("key"), key_bits(F.col(key)).alias("__bits"))
    deep = bits.withColumn("depth", F.explode(F.sequence(F.lit(0), F.length("__bits"))))
    return deep.select("key", "depth", F.substring("__bits", F.lit(1), F.col("depth")).alias("prefix"))


def subtree_weights(keys: DataFrame, key: str) -> DataFrame:
    """(prefix, n, weight) per bit prefix: n keys below it, weight floor(log2 n)."""
    return bit_prefixes(keys, key).groupBy("prefix").agg(F.count("*").alias("n")).withColumn("weight", floor_log2(F.col("n")))


def chain_crossings(keys: DataFrame, key: str) -> DataFrame:
    """(key, crossings) per distinct key: heavy paths that a lookup passes, one and one more wherever the sibling is as
    large or larger.

    A sibling exists only where keys part, so keys are counted by the bytes before a place (hashed to 128 bits) and the byte there, in
    place of every bit: a row of fixed size for each byte, summed before the shuffle. Where two bytes or more follow, at most
    256 counts give the sizes of both sides of each bit; only bytes with a larger sibling are joined back.
    """
    at = keys.select(F.col(key).alias("key")).where(F.octet_length("key") > 0).select("key", F.explode(F.sequence(F.lit(0), F.octet_length("key") - 1)).alias("depth"))
    before = F.substring("key", F.lit(1), F.col("depth"))
    byte = F.conv(F.hex(F.substring("key", F.col("depth") + 1, F.lit(1))), 16, 10).cast("int")
    node = ["depth", "h", "h2"]
    steps = at.select("key", "depth", F.xxhash64(before).alias("h"), F.xxhash64(F.lit(1), before).alias("h2"), byte.alias("byte"))
    sides = steps.groupBy(*node, "byte").agg(F.count("*").alias("n")).groupBy(*node).agg(F.collect_list(F.struct("byte", "n")).alias("all")).where(F.size("all") > 1)

    def size(side: Column, bit: Column) -> Column:
        below = F.filter("all", lambda x: F.call_function("shiftright", x["byte"], bit) == side)
        return F.aggregate(below, F.lit(0).cast("long"), lambda total, x: total + x["n"])

    def larger(bit: Column) -> Column:
        side = F.call_function("shiftright", F.col("byte"), bit)
        return size(side.bitwiseXOR(F.lit(1)), bit) >= size(side, bit)

    parted = sides.select(*node, "all", F.explode("all.byte").alias("byte"))
    light = parted.select(*node, "byte", F.size(F.filter(F.sequence(F.lit(0), F.lit(7)), larger)).cast("long").alias("c")).where(F.col("c") > 0)
    passed = steps.join(light, [*node, "byte"]).select("key", "c")
    return keys.select(F.col(key).alias("key"), F.lit(1).cast("long").alias("c")).distinct().unionByName(passed).groupBy("key").agg(F.sum("c").alias("crossings"))
