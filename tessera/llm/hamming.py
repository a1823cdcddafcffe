"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is cut into segments of 16 bits, each with a hash index from segment value to codes. A search
looks up all values within radius r of each query segment, r = 0, 1, 2, ...: after radius r in all m
segments every code within Hamming distance m (r + 1) - 1 has been met (two codes farther apart than r in
each segment differ in m (r + 1) bits or more), so a query whose k-th verified distance is at most that is
covered and leaves. Ties are broken by id.

Codes that repeat are one entry with its k + 1 smallest ids, which is all that a top-k can return of them;
the cut is made before the shuffle. A pair is verified once: in the round of its smallest segment distance,
in the first such segment, and passed on only if it is no farther than the k-th one so far. What a round adds is reduced to the best k + 1 per query before the shuffle.

Defined results: a null vector has no code, is not found, and finds nothing; null elements and ones that are
not positive are 0 bits; a null id sorts first; a table of up to k codes gives all there are; rows that repeat a
query are searched once for each distinct code and answered one by one, and an equal id is never its own
neighbour. An empty table gives none. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import Scratch

BITS = 16


def sign_code(vector: Column) -> Column:
    """Segments of 16 sign bits, the last filled up with 0; null for a null vector."""
    n = F.ceil(F.size(vector) / F.lit(float(BITS))).cast("int")
    bit = lambda x, i: F.when(x > 0, F.shiftleft(F.lit(1), 0)).otherwise(0)
    segment = lambda s: F.aggregate(F.slice(F.transform(vector, bit), s * BITS + 1, BITS), F.lit(0), lambda a, x: a * 2 + x)
    return F.when(vector.isNotNull() & (F.size(vector) > 0), F.transform(F.sequence(F.lit(0), n - 1), segment))


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, *, id_col: str = "vec_id", code_col: str = "code") -> DataFrame:
    """(query_id, rank, neighbour_id, distance) for ``queries``, rows of the same shape; all codes have as many segments."""
    spark = rows.sparkSession
    scratch, most = Scratch(spark, "hamming"), k + 1
    light = rows.select(F.col(id_col).alias("id"), F.col(code_col).alias("code")).where(F.col("code").isNotNull())
    first = light.withColumn("_n", F.row_number().over(W.partitionBy("code").orderBy(F.col("id").asc_nulls_first()))).where(F.col("_n") <= most)
    codes = scratch.write(first.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"), F.count_if(F.col("id").isNull()).alias("nulls")), "codes")
    shape = codes.agg(F.count("*").alias("n"), F.max(F.size("code")).alias("m")).first()
    enough, m = min(most, shape["n"]), shape["m"] or 1
    wanted = scratch.write(queries.select(F.col(id_col).alias("query_id"), F.col(code_col).alias("query")).where(F.col(code_col).isNotNull()), "queries")
    open_ = scratch.write(wanted.select("query").distinct().withColumns({"bound": F.lit(None).cast("int"), "radius": F.lit(0)}), "open")
    masks = spark.range(1 << BITS).select(F.col("id").cast("int").alias("mask"), F.bit_count("id").alias("radius"))  # 65,536 rows, whatever the data
    entries = codes.select("code", F.when(F.col("nulls") == 0, F.get("ids", F.lit(0))).alias("first"), F.posexplode("code").alias("segment", "value"))
    index = entries.repartition("segment", "value").persist()
    best = done = None
    for r in range(BITS + 1):
        keys = open_.join(F.broadcast(masks), "radius").select("query", "bound", "mask", F.posexplode("query").alias("segment", "_v"))
        keys = keys.select("query", "bound", "segment", F.col("_v").bitwiseXOR(F.col("mask")).alias("value"))
        apart = F.zip_with("query", "code", lambda x, y: F.bit_count(x.bitwiseXOR(y)))
        distance = F.aggregate(apart, F.lit(0), lambda s, x: s + x)
        new = (F.array_position(apart, F.lit(r)) == F.col("segment") + 1) & (F.array_min(apart) == r)
        met = keys.join(index, ["segment", "value"]).where(new & (F.col("bound").isNull() | (distance <= F.col("bound"))))
        met = met.select("query", "code", "first", distance.alias("distance"))
        over = W.partitionBy("query").orderBy("distance", F.col("first").asc_nulls_first(), "code")
        pool = met if best is None else best.unionByName(met)
        found = scratch.write(pool.withColumn("_k", F.row_number().over(over)).where(F.col("_k") <= most).drop("_k"), f"found{r}")
        stats = found.groupBy("query").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
        covered = (F.coalesce("n", F.lit(0)) >= enough) & (F.coalesce("far", F.lit(0)) <= m * (r + 1) - 1)
        rest = scratch.write(open_.join(stats, "query", "left").where(~covered).select("query", F.when(F.col("n") >= enough, F.col("far")).alias("bound"), F.lit(r + 1).alias("radius")), f"open{r}")
        closed = found.join(rest, "query", "left_anti")
        done = closed if done is None else done.unionByName(closed)
        best, open_ = found.join(rest, "query", "left_semi"), rest
        if r == BITS or rest.isEmpty():  # at the last radius every code has been met
            break
    done = done if r < BITS else done.unionByName(best)
    index.unpersist()
    ids = F.concat("ids", F.array_repeat(F.lit(None).cast(light.schema["id"].dataType), F.col("nulls").cast("int")))
    near = done.join(codes.select("code", ids.alias("_ids")), "code").select("query", "distance", F.explode("_ids").alias("id"))
    answers = wanted.join(near, "query").where(~F.col("id").eqNullSafe(F.col("query_id")))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", F.col("id").asc_nulls_first()))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("neighbour_id"), "distance")
