"""Mutations as plans over (current rows, changes).

Every function takes the current rows and gives outcomes or changes; nothing here writes. A change is a row with
the columns of the table and the flag ``__deleted``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

OK, DUPLICATE, MISSING = "OK", "DUPLICATE KEY", "NOT FOUND"


def outcomes(current_keys: DataFrame, ops: DataFrame, pk: str, pos: str = "pos", op: str = "op") -> DataFrame:
    """``ops`` with ``outcome``: the reply to each of NEW, UPDATE and DELETE applied in order of ``pos``.

    Whether a key is present before an operation follows from the last NEW or DELETE of that key before it, done or
    refused, and otherwise from the table; so a window over the key tells all replies at once. A verb with a mark
    behind it ("NEW!") is answered alike, but changes nothing.
    """
    now = current_keys.select(F.col(pk).alias("__k")).withColumn("__there", F.lit(True))
    before = W.partitionBy(pk).orderBy(pos).rowsBetween(W.unboundedPreceding, -1)
    decides = F.when(F.col(op) == "NEW", True).when(F.col(op) == "DELETE", False)
    marked = ops.join(now, F.col(pk) == F.col("__k"), "left").withColumn("__before", F.coalesce(F.last(decides, ignorenulls=True).over(before), F.col("__there"), F.lit(False)))
    outcome = F.when(F.col(op).startswith("NEW"), F.when(F.col("__before"), DUPLICATE).otherwise(OK)).otherwise(F.when(F.col("__before"), OK).otherwise(MISSING))
    return marked.withColumn("outcome", outcome).drop("__k", "__there", "__before")


def last_changes(done: DataFrame, pk: str, cols: list[str], pos: str = "pos", op: str = "op") -> DataFrame:
    """What the successful operations leave of each key they touch: its last row, or a deletion. Partial aggregates."""
    row = F.struct(*cols, (F.col(op) == "DELETE").alias("__deleted"))
    last = done.where(F.col("outcome") == OK).groupBy(pk).agg(F.max_by(row, F.col(pos)).alias("__row"))
    return last.select("__row.*")


def bulk_new(current_keys: DataFrame, rows: DataFrame, pk: str, pos: str) -> DataFrame:
    """Rows that BULK inserts: the first of each key in the batch, unless the table has the key."""
    cols = [c for c in rows.columns if c != pos]
    first = rows.groupBy(pk).agg(F.min_by(F.struct(*cols), F.col(pos)).alias("__row")).select("__row.*")
    return first.join(current_keys.select(pk), pk, "left_anti").select(*cols)


def merge(base: DataFrame, changes: DataFrame, pk: str) -> DataFrame:
    """Current rows: those of ``base`` that no change touches, and the changes that are not deletions."""
    live = changes.where(~F.col("__deleted")).drop("__deleted")
    return base.join(changes.select(pk), pk, "left_anti").select(*base.columns).unionByName(live.select(*base.columns))


def update_rows(df: DataFrame, pk: str, rows: DataFrame) -> DataFrame:
    """Full-row replacement of the keys that exist; other rows of ``rows`` change nothing."""
    found = rows.join(df.select(pk), pk, "left_semi").select(*df.columns)
    return df.join(rows.select(pk), pk, "left_anti").select(*df.columns).unionByName(found)


def delete_rows(df: DataFrame, pk: str, keys: DataFrame) -> DataFrame:
    return df.join(keys.select(pk), pk, "left_anti").select(*df.columns)


def modify(df: DataFrame, pk: str, keys: DataFrame, field: str, value: Column) -> DataFrame:
    """Read-modify-write of one field of the listed keys."""
    hit = keys.select(F.col(pk).alias("__k")).distinct()
    return df.join(hit, F.col(pk) == F.col("__k"), "left").withColumn(field, F.when(F.col("__k").isNotNull(), value).otherwise(F.col(field))).select(*df.columns)


def fold(log: DataFrame, pk: str, lsn: str, op: str, value: Column, name: str = "v") -> DataFrame:
    """The latest state per key of a log of NEW, UPDATE and DELETE; lsn from 1.

    After a key's last DELETE its first NEW sets the row and later UPDATEs replace it. Three aggregations with
    map-side partials instead of a window, so a key with a third of the log is never in one task.
    """
    log = log.select(F.col(pk).alias("__k"), F.col(lsn).alias("__lsn"), F.col(op).alias("__op"), value.alias("__v"))
    deleted = log.groupBy("__k").agg(F.coalesce(F.max(F.when(F.col("__op") == "DELETE", F.col("__lsn"))), F.lit(0)).alias("__dl"))
    since = log.join(deleted, "__k").where(F.col("__lsn") > F.col("__dl"))
    first = since.where(F.col("__op") == "NEW").groupBy("__k").agg(F.min("__lsn").alias("__nl"))
    live = since.join(first, "__k").where((F.col("__lsn") == F.col("__nl")) | (F.col("__op") == "UPDATE") & (F.col("__lsn") > F.col("__nl")))
    return live.groupBy("__k").agg(F.max_by("__v", "__lsn").alias(name)).withColumnRenamed("__k", pk)
