"""Keyed tables as versioned Parquet snapshots.

A table is a folder: manifests ``manifest-<version>.json``, base snapshots sorted by key, and deltas. A manifest
names one base and the deltas over it; committing is renaming a manifest into place, and readers use the newest.
A mutation writes one small delta and never rewrites the base: rows are merged when they are read, and ``compact``
folds deltas into a new base. So a change costs what it changes, whatever the table's size.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.keys import U64, key_column
from tessera.operators import layout, read, write
from tessera.plans.lexer import CommandError
from tessera.plans.parser import ColumnDef, TableSchema
from tessera.sources.store import Store

KEY, DELETED = read.KEY, "__deleted"
#: As many deltas are folded into a new base by the mutation that adds the last of them, so a read merges fewer.
MOST_DELTAS = 64


def struct_of(schema: TableSchema) -> T.StructType:
    """Spark's schema of a table; sizes and the key are in the fields' metadata."""
    kinds = {"string": T.StringType(), "number": U64}
    return T.StructType([T.StructField(c.name, kinds[c.kind], False, {"max_bytes": c.max_bytes, "pk": i == schema.pk}) for i, c in enumerate(schema.columns)])


def plain(struct: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType) for f in struct])


@dataclass(frozen=True)
class Manifest:
    schema: TableSchema
    version: int = 0
    base: str | None = None
    deltas: tuple[str, ...] = ()
    applied_lsn: int = 0
    rows: int | None = 0  # of the table; null in a manifest that was written without it

    def text(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def of(cls, text: str) -> Manifest:
        d = json.loads(text)
        s = d.pop("schema")
        cols = tuple(ColumnDef(**c) for c in s.pop("columns"))
        return cls(schema=TableSchema(columns=cols, **s), deltas=tuple(d.pop("deltas")), **({"rows": None} | d))


@dataclass
class Table:
    """A managed table; ``manifest`` is its newest version."""

    store: Store
    name: str
    manifest: Manifest

    @property
    def schema(self) -> TableSchema:
        return self.manifest.schema

    @property
    def pk(self) -> str:
        return self.schema.key.name

    @property
    def struct(self) -> T.StructType:
        return plain(struct_of(self.schema))

    def _read(self, names: list[str], struct: T.StructType) -> DataFrame:
        spark = self.store.spark
        return spark.read.schema(struct).parquet(*[self.store.path(f"{self.name}/{n}") for n in names]) if names else spark.createDataFrame([], struct)

    def base(self) -> DataFrame:
        return self._read([self.manifest.base] if self.manifest.base else [], T.StructType(self.struct.fields + [T.StructField(KEY, T.BinaryType())]))

    def changes(self) -> DataFrame:
        """The last change of each key that the deltas touch."""
        struct = T.StructType(self.struct.fields + [T.StructField(KEY, T.BinaryType()), T.StructField(DELETED, T.BooleanType()), T.StructField("__version", T.LongType())])
        df = self._read(list(self.manifest.deltas), struct)
        if len(self.manifest.deltas) > 1:
            df = df.groupBy(self.pk).agg(F.max_by(F.struct(*df.columns), F.col("__version")).alias("__row")).select("__row.*")
        return df.drop("__version")

    def frame(self) -> DataFrame:
        """Current rows with their stored key."""
        if not self.manifest.deltas:
            return self.base()
        return write.merge(self.base(), self.changes(), self.pk)

    def rows(self) -> DataFrame:
        return self.frame().select(*[c.name for c in self.schema.columns])

    def _commit(self, m: Manifest) -> None:
        self.store.write(f"{self.name}/manifest-{m.version:010d}.json", m.text())
        self.manifest = m

    def add_delta(self, changes: DataFrame, lsn: int = 0, added: int | None = None) -> None:
        """Write changes (table columns and ``__deleted``) as the next version; ``added``: rows more, if that is known."""
        version = self.manifest.version + 1
        key = key_column(F.col(self.pk), self.struct[self.pk].dataType, self.schema.key_order)
        name = f"delta-{version:010d}"
        out = changes.select(*[c.name for c in self.schema.columns], key.alias(KEY), DELETED, F.lit(version).cast("long").alias("__version"))
        out.sortWithinPartitions(KEY).write.mode("overwrite").parquet(self.store.path(f"{self.name}/{name}"))
        rows = None if added is None or self.manifest.rows is None else self.manifest.rows + added
        self._commit(replace(self.manifest, version=version, deltas=(*self.manifest.deltas, name), applied_lsn=max(lsn, self.manifest.applied_lsn), rows=rows))
        if len(self.manifest.deltas) >= MOST_DELTAS:
            self.compact()

    def compact(self, file_rows: int = layout.FILE_ROWS) -> None:
        """Fold everything into one base sorted by key over range partitions; the rows stay what they are."""
        version = self.manifest.version + 1
        name, df = f"base-{version:010d}", self.frame()
        rows = df.count()
        out = layout.sorted_by_key(df, KEY, rows, file_rows).write.mode("overwrite").option("compression", "zstd")
        # point reads of keys that a row group lacks skip it
        out = out.option(f"parquet.bloom.filter.enabled#{self.pk}", "true").option(f"parquet.bloom.filter.expected.ndv#{self.pk}", str(max(1, min(rows, file_rows))))
        out.parquet(self.store.path(f"{self.name}/{name}"))
        self._commit(replace(self.manifest, version=version, base=name, deltas=(), rows=rows))

    def vacuum(self, keep: int = 0) -> list[str]:
        """Delete snapshots that neither the newest manifest names nor the ``keep`` before it, for readers that began
        with those, and older manifests."""
        olds = sorted(n for n in self.store.names(self.name) if n.startswith("manifest-"))[:-1]
        before = {n: Manifest.of(self.store.read(f"{self.name}/{n}")) for n in (olds[-keep:] if keep else [])}
        keep = {f"manifest-{self.manifest.version:010d}.json", *before, *(x for m in (self.manifest, *before.values()) for x in (m.base, *m.deltas))}
        gone = [n for n in self.store.names(self.name) if n not in keep]
        for n in gone:
            self.store.delete(f"{self.name}/{n}")
        return gone

    def load(self, df: DataFrame, pos: str | None = None) -> int:
        """BULK from a DataFrame of any size: the first of each new key by ``pos``. Number of rows inserted."""
        spark_pos = pos or "__pos"
        rows = df if pos else df.withColumn(spark_pos, F.monotonically_increasing_id())
        typed = rows.select(*[F.col(c.name).cast(f.dataType).alias(c.name) for c, f in zip(self.schema.columns, self.struct, strict=True)], spark_pos)
        new = write.bulk_new(self.rows(), typed, self.pk, spark_pos).persist()
        try:
            return self.insert(new)
        finally:
            new.unpersist()

    def insert(self, new: DataFrame, lsn: int = 0) -> int:
        """Add rows whose keys are new, if no value is too long; how many. One aggregate tells both."""
        strings = [c for c in self.schema.columns if c.kind == "string"]
        checks = new.agg(F.count("*").alias("__n"), *[F.coalesce(F.max(F.octet_length(c.name)), F.lit(0)).alias(c.name) for c in strings]).first()
        for c in strings:
            if checks[c.name] > c.max_bytes:
                raise CommandError(f"value too long for column '{c.name}'")
        if checks["__n"]:
            self.add_delta(new.withColumn(DELETED, F.lit(False)), lsn, checks["__n"])
        return checks["__n"]


class Catalog:
    """Managed tables below a folder, and Parquet tables attached to read."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)
        self.tables: dict[str, Table] = {}
        self.attached: dict[str, tuple[DataFrame, str, str]] = {}
        for name in self.store.names():
            if not name.startswith(("_", ".")):
                versions = [n for n in self.store.names(name) if n.startswith("manifest-")]
                if versions:
                    self.tables[name] = Table(self.store, name, Manifest.of(self.store.read(f"{name}/{versions[-1]}")))

    def create(self, schema: TableSchema, lsn: int = 0) -> Table:
        if schema.name in self.tables or schema.name in self.attached:
            raise CommandError(f"table '{schema.name}' already exists")
        m = Manifest(schema, version=1, applied_lsn=lsn)
        self.store.write(f"{schema.name}/manifest-{m.version:010d}.json", m.text())
        self.tables[schema.name] = Table(self.store, schema.name, m)
        return self.tables[schema.name]

    def attach(self, name: str, df: DataFrame, pk: str, order: str = "be") -> None:
        """A read-only table over any DataFrame with a single-column key."""
        self.attached[name] = (df, pk, order)

    def get(self, name: str) -> Table:
        if name not in self.tables:
            raise CommandError(f"unknown table: {name}")
        return self.tables[name]

    def schema(self, name: str) -> TableSchema:
        if name in self.attached:
            df, pk, order = self.attached[name]
            cols = tuple(ColumnDef(f.name, "string" if isinstance(f.dataType, T.StringType) else "number", 1 << 31) for f in df.schema)
            return TableSchema(name, cols, df.columns.index(pk), order)
        return self.get(name).schema

    def frame(self, name: str) -> tuple[DataFrame, str, str]:
        """Rows, key column and key order."""
        if name in self.attached:
            return self.attached[name]
        t = self.get(name)
        return t.frame(), t.pk, t.schema.key_order

    def views(self) -> None:
        """A temporary view for every table, for SQL beside the command language."""
        for name in [*self.tables, *self.attached]:
            df = self.frame(name)[0]
            df.select(*[c for c in df.columns if not c.startswith("__")]).createOrReplaceTempView(name)
