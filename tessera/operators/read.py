"""Reads by primary key: lazy DataFrames over any frame that has the key column.

A predicate on a stored key column is a literal comparison that reaches the Parquet scan, where files sorted
by key skip row groups. Point reads use the native column: equality does not depend on the encoding.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.keys import key_bytes, key_column, lit_key, lit_value

KEY = "__key"


def with_key(df: DataFrame, pk: str, order: str = "le") -> DataFrame:
    """``df`` with its key bytes, unless it stores them."""
    return df if KEY in df.columns else df.withColumn(KEY, key_column(F.col(pk), df.schema[pk].dataType, order))


def _shown(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("__")]


def query(df: DataFrame, pk: str, value: str | int) -> DataFrame:
    """The row with this key, if there is one."""
    return df.where(F.col(pk) == lit_value(value, df.schema[pk].dataType)).select(*_shown(df))


def between(df: DataFrame, pk: str, lo: str | int, hi: str | int, order: str = "le") -> Column:
    """lo <= key <= hi in key order; a native comparison where that order is the column's own."""
    if KEY not in df.columns and (order == "be" or isinstance(lo, str)):
        kind = df.schema[pk].dataType
        return F.col(pk).between(lit_value(lo, kind), lit_value(hi, kind))
    key = F.col(KEY) if KEY in df.columns else key_column(F.col(pk), df.schema[pk].dataType, order)
    return key.between(lit_key(key_bytes(lo, order)), lit_key(key_bytes(hi, order)))


def ordering(df: DataFrame, pk: str, order: str = "le") -> Column:
    if KEY in df.columns:
        return F.col(KEY)
    native = order == "be" or df.schema[pk].dataType.simpleString() == "string"
    return F.col(pk) if native else key_column(F.col(pk), df.schema[pk].dataType, order)


def range_scan(df: DataFrame, pk: str, lo: str | int, hi: str | int, order: str = "le") -> DataFrame:
    """Rows from lo to hi, both included, in key order; none if lo is after hi."""
    return df.where(between(df, pk, lo, hi, order)).orderBy(ordering(df, pk, order)).select(*_shown(df))


def in_list(df: DataFrame, pk: str, keys: Sequence[str | int], pos: str | None = None) -> DataFrame:
    """Rows of the keys that exist, in the order of the list, as often as a key is listed.

    The list comes from one command and is broadcast; its distinct values are also a pushed-down filter.
    """
    spark, kind = df.sparkSession, df.schema[pk].dataType
    wanted = spark.createDataFrame([(i, str(k)) for i, k in enumerate(keys)], "__pos long, __text string").select("__pos", F.col("__text").cast(kind).alias("__wanted"))
    found = df.where(F.col(pk).isin([lit_value(k, kind) for k in dict.fromkeys(keys)])) if 0 < len(keys) <= 1000 else df
    out = found.join(F.broadcast(wanted) if len(keys) <= 100_000 else wanted, F.col(pk) == F.col("__wanted")).orderBy("__pos")
    return out.select(*([F.col("__pos").alias(pos)] if pos else []), *_shown(df))


def in_join(df: DataFrame, pk: str, keys: DataFrame, key_col: str, pos: str) -> DataFrame:
    """IN for a table of keys of any size: rows with the position of each listed key."""
    k = keys.select(F.col(pos), F.col(key_col).alias("__wanted"))
    return df.join(k, F.col(pk) == F.col("__wanted")).select(pos, *_shown(df))


def lower_bound(df: DataFrame, pk: str, lo: str | int, order: str = "le") -> DataFrame:
    """The first row whose key is lo or after."""
    return page(df, pk, lo, 1, order=order)


def page(df: DataFrame, pk: str, lo: str | int | None, n: int, *, after: bool = False, order: str = "le") -> DataFrame:
    """A cursor's next n rows in key order, from lo on, or after it; a top-n plan, no full sort."""
    by = ordering(df, pk, order)
    if lo is not None:
        bound = lit_key(key_bytes(lo, order)) if KEY in df.columns or order == "le" and not isinstance(lo, str) else lit_value(lo, df.schema[pk].dataType)
        df = df.where(by > bound if after else by >= bound)
    return df.orderBy(by).limit(n).select(*_shown(df))


def prefix(df: DataFrame, pk: str, start: str) -> DataFrame:
    return df.where(F.col(pk).startswith(start)).orderBy(ordering(df, pk)).select(*_shown(df))


def count(df: DataFrame, name: str = "records") -> DataFrame:
    return df.agg(F.count("*").alias(name))


def where(df: DataFrame, pk: str, predicate: str | Column, order: str = "le") -> DataFrame:
    """Any predicate, in key order."""
    return df.where(predicate).orderBy(ordering(df, pk, order)).select(*_shown(df))


def range_join(df: DataFrame, pk: str, ranges: DataFrame, lo: str, hi: str, cell: int) -> DataFrame:
    """Many ranges over a number key as one equi-join on cells of ``cell`` keys: each row comes with every range it is in.

    ``ranges`` are closed intervals; one that spans many cells is in each of them, so cells are about as wide as ranges.
    """
    r = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))))
    return df.withColumn("__cell", F.floor(F.col(pk) / cell)).join(r, "__cell").where(F.col(pk).between(F.col(lo), F.col(hi))).drop("__cell")
