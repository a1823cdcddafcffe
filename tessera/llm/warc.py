"""WARC archives, index first.

``write`` makes one archive per task in a shared folder, each record a gzip member of its own, and returns
the index: file, offset, length, URL and digest per record. ``read`` takes index rows, deals them out by
ranges of (file, offset), sorts them, coalesces neighbouring byte ranges into one read each, and parses
the records. Of rows with equal payloads (SHA-1 and length, payloads of at least ``min_bytes``) those with
the smallest id are responses, the others revisits that refer to it and carry no payload.

The index is written out in the same job as the archives, so it names only files of tasks that succeeded; a
task that is run again writes another file, and what a lost attempt left is never read.

Defined results: a null payload is empty; a null URL is left out of the record and comes back null; white
space and control characters in a URL are percent-encoded; a null id is written as "null" and is a
revisit if another row with the payload has an id; rows that repeat the smallest id are all responses;
an empty table gives an empty index. Columns other than id, URL and payload are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, apart, small_batches

DATE = "1970-01-01T00:00:00Z"  # captures have no date of their own
#: An archive is closed at this size; a read is closed at the other; gaps up to the third are read over.
ARCHIVE_BYTES, READ_BYTES, GAP_BYTES = 1 << 30, 8 << 20, 64 << 10
INDEX = "page_id long, url string, record_type string, payload_digest string, file string, offset long, length long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def _parse_id(text: str) -> int | None:
    value = text.strip("<>").rpartition(":")[2]
    return None if value == "null" else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, sha: str | None = None) -> bytes:
    """One record; a revisit if refers_to is given. The HTTP head states the full payload's length in both."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _id(page_id)),
        *([("WARC-Target-URI", UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url))] if url is not None else []),
        ("WARC-Date", DATE),
        *([("WARC-Refers-To", _id(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")] if refers_to is not None else []),
        ("WARC-Payload-Digest", f"sha1:{sha or digest(payload)}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields; the payload is None for a revisit, and a response's is held against its digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    kind, sha = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or digest(payload) != sha):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {"page_id": _parse_id(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "payload_bytes": length, "payload_digest": sha, "record_type": kind, "refers_to": _parse_id(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def with_revisits(pages: DataFrame, *, id_col: str, url_col: str, payload_col: str, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): payloads in UTF-8, refers_to the id of the response or null."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    keyed = rows.select("page_id", F.unhex(F.sha1("payload")).alias("sha"), F.octet_length("payload").alias("n"))
    shared = keyed.where(F.col("n") >= min_bytes).groupBy("sha", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("_c")).where(F.col("_c") > 1)
    shared = Scratch(pages.sparkSession, "payloads").write(shared.select(F.col("sha").alias("_sha"), F.col("n").alias("_n"), "first"), "shared")
    maybe, own = apart(rows.withColumn("sha", F.unhex(F.sha1("payload"))), F.col("sha"), shared, F.col("_sha"))  # a payload that is alone is not shuffled
    joined = maybe.join(shared, (F.col("sha") == F.col("_sha")) & (F.octet_length("payload") == F.col("_n")), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    return joined.select("page_id", "url", "payload", refers).unionByName(own.select("page_id", "url", "payload", F.lit(None).cast("long").alias("refers_to")))


def write(rows: DataFrame, folder: str, scratch: Scratch) -> DataFrame:
    """Archives in ``folder`` from (page_id, url, payload, refers_to); the index, written out."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            index: dict[str, list] = {k: [] for k in ("page_id", "url", "record_type", "payload_digest", "file", "offset", "length")}
            for page, url, payload, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    name, at = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                sha = digest(payload)
                z = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = z.compress(record(page, url, payload, refers, sha)) + z.flush()
                out.write(data)
                for k, v in zip(index, (page, url, "response" if refers is None else "revisit", sha, name, at, len(data)), strict=True):
                    index[k].append(v)
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(index.values(), kinds, strict=True)], names=list(index))
        if out is not None:
            out.close()

    return scratch.write(rows.select("page_id", "url", "payload", "refers_to").mapInArrow(run, INDEX), "index")


def coalesce(spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
    """Sorted (file, offset, length) as reads: file, start, size, and the spans within."""
    now: list = []
    for file, offset, length in spans:
        if now and file == now[0] and offset - now[2] <= GAP_BYTES and offset + length - now[1] <= READ_BYTES:
            now[2] = max(now[2], offset + length)
            now[3].append((offset, length))
            continue
        if now:
            yield now[0], now[1], now[2] - now[1], now[3]
        now = [file, offset, offset + length, [(offset, length)]]
    if now:
        yield now[0], now[1], now[2] - now[1], now[3]


def read(index: DataFrame, folder: str, *, parts: int | None = None, payloads: bool = True) -> DataFrame:
    """Records of the selected index rows."""
    spark = index.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        name, file = "", None
        for batch in batches:
            spans = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True))
            for path, start, size, within in coalesce(spans):
                if path != name:
                    if file is not None:
                        file.close()
                    name, file = path, fs.open_input_file(f"{base}/{path}")
                data = file.read_at(size, start)
                got = [parse(zlib.decompress(data[o - start : o - start + n], 31)) for o, n in within]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] if payloads or k != "payload" else None for r in got], t) for k, t in (("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()))],
                    names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"],
                )
        if file is not None:
            file.close()

    return index.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset").mapInArrow(run, RECORD)


def round_trip(spark: SparkSession, pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write every page to archives in the shared folder, and read them back through the index."""
    scratch = Scratch(spark, "warc")
    folder = scratch.folder("archives")
    index = write(with_revisits(pages, id_col=id_col, url_col=url_col, payload_col=payload_col, min_bytes=min_bytes), folder, scratch)
    return read(index, folder, payloads=False).drop("payload")
