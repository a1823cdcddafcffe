"""Small text files in whatever file system Spark reads, through its own client."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        fs, p = self._path(name)
        return fs.exists(p)

    def names(self, name: str = "") -> list[str]:
        fs, p = self._path(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, name: str) -> str | None:
        fs, p = self._path(name)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """All or nothing: another file first, then a rename to a name that must be free."""
        fs, p = self._path(name)
        if fs.exists(p):
            raise FileExistsError(name)
        folder, _, base = name.rpartition("/")
        _, tmp = self._path(f"{folder}/.{base}-{uuid.uuid4().hex}" if folder else f".{base}-{uuid.uuid4().hex}")
        stream = fs.create(tmp, True)
        try:
            stream.write(bytearray(text.encode()))
            if hasattr(stream, "hsync"):
                stream.hsync()
        finally:
            stream.close()
        if not fs.rename(tmp, p):
            raise FileExistsError(name)

    def delete(self, name: str) -> None:
        fs, p = self._path(name)
        fs.delete(p, True)
