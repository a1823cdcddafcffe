"""Mixing sources to target weights by subset-sum budget fitting.

1. Each source has a target number of words: the budget is shared by weight, a source's target stops at
   ``most`` times its size, and the excess is reshared by weight until no target is above that.
2. A source's whole documents are taken as often as the target allows (0, 1, ... times each); the rest
   of the target is a subset-sum problem. Documents are counted by exact length; lengths get
   proportional counts first (systematic rounding from short to long), and a bounded-knapsack dynamic
   program over the lengths left fits the remaining budget, which is a few document lengths at most.
3. Of the documents of a length, that many are selected by the order of a seeded hash of the id.

Every step is deterministic for a seed. Large groups of one length are cut into about sqrt(n) buckets by
hash, so no task ranks a whole group.

Defined results: a null or empty text has size 0 and is never taken; a null source is a source of its
own, last in order; rows that repeat are documents of their own (equal rows are interchangeable); an
empty table gives an empty result with targets nowhere. Input columns named like a result are replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from tessera.llm.common import Scratch, own_names, without

WEIGHTS = (3, 1, 2)
RESULTS = ("size", "source_size", "target", "taken")


def word_count(text: Column) -> Column:
    """Number of runs of characters other than white space (0x20, 0x09-0x0D)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple = WEIGHTS, budget: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source (source, source_size) in, with weight and target out.

    The order of sources is found by range partitions and their counts, and resharing is a loop of small
    aggregates whose results are single rows: the sources themselves never meet in one task.
    """
    spark = sizes.sparkSession
    scratch = Scratch(spark, "targets")
    parts = max(1, min(64, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    ordered = scratch.write(sizes.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("_part", F.spark_partition_id()), "ordered")
    before, at = {}, 0
    for r in ordered.groupBy("_part").count().orderBy("_part").collect():  # a row for each of at most 64 partitions
        before[r["_part"]], at = at, at + r["count"]
    if not before:
        return ordered.select("source", "source_size", F.lit(0.0).alias("weight"), F.lit(0.0).alias("target"))
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("_part")]
    rank = F.row_number().over(W.partitionBy("_part").orderBy(F.col("source").asc_nulls_last())) - 1 + offset
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod(rank, F.lit(len(weights))).cast("int")]
    ranked = scratch.write(ordered.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * most).alias("_cap")), "ranked")
    total = budget * float(ranked.agg(F.sum("source_size")).first()[0])
    level, full = 0.0, -1
    while True:  # each turn fills one source or more, or ends
        filled = F.col("_cap") <= F.col("weight") * level
        x = ranked.agg(F.sum(F.when(filled, F.col("_cap")).otherwise(0.0)).alias("caps"), F.sum(F.when(filled, 0.0).otherwise(F.col("weight"))).alias("weights"), F.count_if(filled).alias("n")).first()
        if x["n"] == full or not x["weights"]:
            break
        full, level = x["n"], max(0.0, total - x["caps"]) / x["weights"]
    return ranked.select("source", "source_size", "weight", F.least(F.col("_cap"), F.col("weight") * F.lit(level)).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length (ascending, positive, distinct) to take: at most ``counts``, and
    their words the largest sum up to ``budget`` that the counts left after proportional rounding allow."""
    if budget <= 0 or not len(sizes):
        return np.zeros(len(sizes), np.int64)
    whole = int((sizes * counts).sum())
    if budget >= whole:
        return counts.astype(np.int64)
    slack = 2 * int(sizes[-1])
    share = max(0, budget - slack) / whole
    upto = np.floor(np.cumsum(counts) * share + 0.5).astype(np.int64)
    take = np.minimum(np.diff(upto, prepend=0), counts).astype(np.int64)
    left = budget - int((sizes * take).sum())
    for i in range(len(sizes) - 1, -1, -1):  # rounding can overshoot by a few of the longest documents
        if left >= 0:
            break
        if take[i]:
            back = min(int(take[i]), -(left // int(sizes[i])))
            take[i] -= back
            left += back * int(sizes[i])
    for i in range(len(sizes) - 1, -1, -1):  # what a document more of each length can fill, long ones first
        if left <= slack:
            break
        more = min(int(counts[i] - take[i]), (left - slack // 2) // int(sizes[i]))
        if more > 0:
            take[i] += more
            left -= more * int(sizes[i])
    # bounded knapsack: a bit for each reachable sum; the first chunk to reach a sum is remembered
    mask, reach, chunks, firsts = (1 << (left + 1)) - 1, 1, [], []
    order = [i for i in range(len(sizes)) if counts[i] > take[i] and sizes[i] <= left]
    for i in order[::-1]:
        room, k = min(int(counts[i] - take[i]), left // int(sizes[i])), 1
        while room > 0 and not reach >> left & 1:
            n = min(k, room)
            new = (reach << (n * int(sizes[i]))) & mask & ~reach
            if new:
                chunks.append((i, n))
                firsts.append(new)
                reach |= new
            room, k = room - n, 2 * k
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for (i, n), new in zip(chunks[::-1], firsts[::-1], strict=True):
        if at and new >> at & 1:
            take[i] += n
            at -= n * int(sizes[i])
    return take


PLAN = T.StructType([T.StructField("source", T.StringType()), T.StructField("size", T.LongType()), T.StructField("n", T.LongType()), T.StructField("target", T.DoubleType()), T.StructField("source_size", T.LongType()), T.StructField("whole", T.LongType()), T.StructField("more", T.LongType())])


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("size", kind="stable").reset_index(drop=True)
    target, total = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
    sizes, counts = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    whole = int(target // total) if total else 0
    more = np.zeros(len(rows), np.int64)
    if total:
        has = sizes > 0
        more[has] = fit(sizes[has], counts[has], round(target - whole * total))
    return pd.DataFrame({"source": rows["source"], "size": sizes, "n": counts, "target": target, "source_size": total, "whole": whole, "more": more})


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, budget: float = 1.5, most: float = 2.0, seed: int = 17) -> DataFrame:
    """(doc_id, row, source, size, source_size, target, taken); row is a hash that tells texts with one id apart."""
    scratch = Scratch(docs.sparkSession, "mix")
    light = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("_h"), F.xxhash64(F.col(text_col)).alias("row"))
    light = scratch.write(light, "sizes")
    lengths = scratch.write(light.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    targets = source_targets(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights=weights, budget=budget, most=most)
    t = targets.select(F.col("source").alias("_s"), "source_size", "target")
    with_targets = lengths.join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    plan = scratch.write(with_targets.groupBy("source").applyInPandas(_fit_source, PLAN), "plan")
    p = plan.select(F.col("source").alias("_s"), F.col("size").alias("_size"), "n", "target", "source_size", "whole", "more")
    joined = light.join(p, F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size")))
    # of each length, `more` documents by hash order: whole buckets first, then ranks within one bucket
    buckets = F.ceil(F.sqrt("n")).cast("long")
    joined = joined.withColumn("_b", F.floor((F.shiftrightunsigned(F.col("_h"), 33) * buckets) / F.lit(float(1 << 31))).cast("long"))
    key = ["source", "size", "_b"]
    sized = light.join(p.where((F.col("more") > 0) & (F.col("more") < F.col("n"))), F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_size")))
    sized = sized.withColumn("_b", F.floor((F.shiftrightunsigned(F.col("_h"), 33) * buckets) / F.lit(float(1 << 31))).cast("long")).groupBy(*key).agg(F.count("*").alias("_c"))
    over = W.partitionBy("source", "size").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    sized = scratch.write(sized.select(F.col("source").alias("_bs"), F.col("size").alias("_bsize"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_c").over(over), F.lit(0)).alias("_before")), "buckets")
    j = joined.join(sized, F.col("source").eqNullSafe(F.col("_bs")) & (F.col("size") == F.col("_bsize")) & (F.col("_b") == F.col("_bb")), "left")
    rank = F.row_number().over(W.partitionBy(*key).orderBy("_h", F.col("doc_id").asc_nulls_last(), "row")) + F.coalesce(F.col("_before"), F.lit(0))
    extra = F.when(F.col("more") >= F.col("n"), 1).when(F.col("more") <= 0, 0).otherwise((F.col("_rank") <= F.col("more")).cast("int"))
    return j.withColumn("_rank", rank).select("doc_id", "row", "source", "size", "source_size", "target", (F.col("size") * (F.col("whole") + extra)).cast("long").alias("taken"))


def take(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that the mix takes, with their columns and size, source_size, target, taken and copies."""
    number = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.lit(0)))  # noqa: E731  of equal rows
    mixed = mix(docs, id_col=id_col, text_col=text_col, **kw).withColumn("_mk", number("doc_id", "row"))
    mixed = mixed.where(F.col("taken") > 0).select(F.col("doc_id").alias("_mid"), F.col("row").alias("_mrow"), "_mk", *RESULTS, F.expr("taken div size").alias("copies"))
    own, back, names = own_names(without(docs, *RESULTS, "copies"))
    own = own.withColumn("_row", F.xxhash64(names[text_col]))
    own = own.withColumn("_k", number(names[id_col], "_row"))
    return own.join(mixed, F.col(names[id_col]).eqNullSafe(F.col("_mid")) & (F.col("_row") == F.col("_mrow")) & (F.col("_k") == F.col("_mk"))).select(*back, *RESULTS, "copies")
