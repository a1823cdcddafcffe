"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch; texts can be long, so the default of 10,000 rows is too many to hold.
BATCH_ROWS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small, so that a Python worker holds BATCH_ROWS texts. Spark reads the setting
    when a plan runs, so it stays set in the session; a smaller one of the caller's is kept."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the session. Where none is named, a temporary one on a local master; on a cluster an error."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        path = f"file://{tempfile.mkdtemp(prefix='tessera-')}"
        sc.setCheckpointDir(path)
    return path.rstrip("/")


class Scratch:
    """Written tables in the shared folder that cut lineage; ``drop`` removes those no longer read.

    Results are read from what is left, so that goes when the application ends, whether it failed or not.
    """

    def __init__(self, spark: SparkSession, job: str):
        self.spark, self.root = spark, f"{checkpoint_dir(spark)}/tessera-{job}-{uuid.uuid4().hex}"
        self.n = 0
        fs, path = self._at(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _at(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def folder(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = self.folder(name)
        # no _SUCCESS: nobody looks for it, and Hadoop's local file system without native code starts processes to set a file's mode
        df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
        out = self.spark.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            fs, p = self._at(df._scratch_path)
            fs.delete(p, True)


def _marked(df: DataFrame, by: Column, keys: DataFrame, key: Column) -> DataFrame:
    """``df`` with the flag ``_maybe``: true if ``by`` is a ``key`` of ``keys``, and for few others.

    A bit set of the keys' hashes, 64 bits a row and 2^20 rows at most whatever their number, is broadcast and
    looked up on the map side, so that a join that follows shuffles little. ``keys`` is a written table. The join that
    follows is not to be a semi join: the optimizer would move that below this one.
    """
    words = 1 << max(8, min(20, (keys.count() // 4).bit_length()))
    spot = lambda c: F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit(7), c), 6), F.lit(words))
    bit = lambda c: F.xxhash64(F.lit(7), c).bitwiseAND(F.lit(63)).cast("int")
    bits = keys.groupBy(spot(key).alias("_spot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit(key))).alias("_bits"))
    near = df.withColumns({"_at": spot(by), "_bit": bit(by)}).join(F.broadcast(bits), F.col("_at") == F.col("_spot"), "left")
    return near.withColumn("_maybe", F.coalesce(F.getbit("_bits", F.col("_bit")) == 1, F.lit(False)))


def maybe_in(df: DataFrame, by: Column, keys: DataFrame, key: Column) -> DataFrame:
    """Rows of ``df`` whose ``by`` may be a ``key`` of ``keys``: all that are, and few others."""
    return _marked(df, by, keys, key).where("_maybe").select(*df.columns)


def apart(df: DataFrame, by: Column, keys: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    """The rows that ``maybe_in`` gives, and all others; the others need no join, and so no shuffle."""
    marked = _marked(df, by, keys, key)
    return marked.where("_maybe").select(*df.columns), marked.where("not _maybe").select(*df.columns)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns that Spark would take for one of ``names``: it ignores case."""
    low = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in low]) if any(c.lower() in low for c in df.columns) else df


def own_names(df: DataFrame) -> tuple[DataFrame, list[Column], dict[str, str]]:
    """``df`` with its columns named c0, c1, ...; columns that bring their names back; and the new name of each.

    Whatever the caller's columns are called, they can't clash with those that an operator adds.
    """
    names = {c: f"c{i}" for i, c in enumerate(df.columns)}
    return df.toDF(*names.values()), [F.col(n).alias(c) for c, n in names.items()], names
