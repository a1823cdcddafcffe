"""Benchmark decontamination with one Aho-Corasick automaton over normalised benchmark windows.

A text is normalised to its words, A-Z in lower case. Every window of ``ngram`` consecutive item words (a shorter item
is one window) is a pattern in the automaton, in which a word is its number in two letters; the text is scanned once, and
what the automaton finds is a range of words, mapped back to character offsets of the original text for those documents
that have any. Two letters a word keep the automaton small (two nodes for each word of a window, not one for each byte)
and quick (a node's children are searched one by one; of V words no node has more than about the root of V).

Defined results: a null or empty text has no words and is never contaminated; a null item text has
no windows; an item without id counts as the item "" ; repeated items and documents are handled row by
row; with an empty benchmark nothing is hit. Columns other than the text are passed on untouched, and
a column of the input whose name is one of the results' is replaced by the result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from itertools import repeat
from math import isqrt

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, own_names, small_batches, without

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD_OR_CAPITAL = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes: A-Z to lower case, whatever is in no word to a space. All bytes of a non-ASCII character are in words.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Bytes of benchmark text behind one automaton; a larger benchmark takes several scans.
BLOCK_BYTES = 2 << 20
RESULTS = ("n_words", "n_hit", "items", "spans")
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def normal_words(raw: bytes) -> list[bytes]:
    return raw.translate(NORMAL).split()


def windows(words: list[bytes], ngram: int) -> set[tuple[bytes, ...]]:
    if len(words) <= ngram:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + ngram]) for i in range(len(words) - ngram + 1)}


class Patterns:
    """The automaton, the letters of its words (any other word is ``OTHER``), and of each pattern its length and items."""

    OTHER = "\0\0"

    def __init__(self, items: list[tuple[str, str]], ngram: int):
        split = [(item, normal_words((text or "").encode("utf-8", "surrogatepass"))) for item, text in items]
        known = dict.fromkeys(w for _, words in split for w in words)
        base = isqrt(len(known)) + 1  # first and second letters are different ones, so a match begins at a word
        self.letters: dict[bytes, str] = {w: chr(0x100 + k // base) + chr(0x20000 + k % base) for k, w in enumerate(known)}
        self.found: list[tuple[int, list[str]]] = []
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for item, words in split:
            for w in windows(words, ngram):
                key = "".join(map(self.letters.__getitem__, w))
                at = self.automaton.get(key, len(self.found))
                if at == len(self.found):
                    self.automaton.add_word(key, at)
                    self.found.append((len(w), []))
                if item not in self.found[at][1]:
                    self.found[at][1].append(item)
        if self.found:
            self.automaton.make_automaton()


_BUILT: dict[str, Patterns] = {}


def _patterns(key: str, sent, ngram: int) -> Patterns:
    """One automaton for each Python worker, kept from task to task."""
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Patterns(sent.value, ngram)
    return _BUILT[key]


def scan(raw: bytes, patterns: Patterns) -> tuple[int, list[tuple[int, int]], set[str]]:
    """Words in the text, ranges of hit words (merged, end exclusive), items hit."""
    words = normal_words(raw)
    ranges: list[list[int]] = []
    items: set[str] = set()
    text = "".join(map(patterns.letters.get, words, repeat(patterns.OTHER)))
    for end, which in patterns.automaton.iter(text) if patterns.found and text else ():
        size, ids = patterns.found[which]
        items.update(ids)
        stop = (end + 1) // 2
        start = stop - size
        while ranges and ranges[-1][1] >= start:  # ends ascend, starts need not
            start = min(start, ranges.pop()[0])
        ranges.append([start, stop])
    return len(words), [(a, b) for a, b in ranges], items


def offsets(text: str, ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Word ranges as character offsets of the original text."""
    if not ranges:
        return []
    at = [m.span() for m in WORD_OR_CAPITAL.finditer(text)]
    return [{"start": at[a][0], "end": at[b - 1][1]} for a, b in ranges]


def merge(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for x, y in sorted([*a, *b]):
        if out and out[-1][1] >= x:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", ngram: int = 13, with_spans: bool = True, block_bytes: int = BLOCK_BYTES, prefix: str = "") -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as strings, sorted) and spans (offsets of hit passages).

    The benchmark is broadcast in blocks of at most ``block_bytes`` of text (or one longer item: none is split), filled
    in order of the items' sizes, which the driver reads first; each block beyond the first takes another scan, written
    out between.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(item_text), F.lit("")).alias("text"))
    items = items.distinct().withColumn("_h", F.xxhash64("item", "text"))
    block_of, sizes = {}, []
    for h, n in items.select("_h", F.octet_length("text")).orderBy(F.octet_length("text"), "_h").toLocalIterator():  # two numbers an item
        if not sizes or sizes[-1] + n > block_bytes:
            sizes.append(0)
        sizes[-1] += n
        block_of[h] = len(sizes) - 1
    blocks = max(1, len(sizes))
    names = [prefix + x for x in (*RESULTS, "_ranges")]
    docs = without(docs, *names)
    keep = docs.columns
    out_schema = docs.select(*keep).schema
    for name, kind in zip(names, (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), SPANS, SPANS), strict=True):
        out_schema.add(name, kind)
    scratch = Scratch(spark, "decontaminate") if blocks > 1 else None
    df = docs.select(*keep)
    for k in range(blocks):
        own = [h for h, b in block_of.items() if b == k]
        block = items if blocks == 1 else items.join(F.broadcast(spark.createDataFrame([(h,) for h in own], "_h long")), "_h")
        sent = spark.sparkContext.broadcast(sorted((r["item"], r["text"]) for r in block.select("item", "text").toLocalIterator()))
        df = df.mapInArrow(_step(sent, uuid.uuid4().hex, text_col, keep, names, ngram, first=k == 0, spans=with_spans and k == blocks - 1), out_schema)
        if k < blocks - 1:
            df = scratch.write(df, "block")
    return df.drop(names[-1])


def _step(sent, key: str, text_col: str, keep: list[str], names: list[str], ngram: int, first: bool, spans: bool):
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _patterns(key, sent, ngram)
        for batch in batches:
            words, hits, items, ranges, out = [], [], [], [], []
            texts = batch.column(text_col).cast(pa.large_string())
            old = None if first else zip(batch.column(names[4]).to_pylist(), batch.column(names[2]).to_pylist(), strict=True)
            for x in texts.cast(pa.large_binary()).to_pylist():
                n, r, ids = scan(x or b"", patterns)
                if old is not None:
                    was, had = next(old)
                    r, ids = merge(r, [(y["start"], y["end"]) for y in was]), ids | set(had)
                words.append(n)
                hits.append(sum(b - a for a, b in r))
                items.append(sorted(ids))
                ranges.append([{"start": a, "end": b} for a, b in r])
                out.append(offsets(x.decode("utf-8", "replace"), r) if spans and r else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(words, pa.int64()), pa.array(hits, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(out, span_type), pa.array(ranges, span_type)], names=[*keep, *names])

    return run


def is_contaminated(share: int = 20, prefix: str = ""):
    """At least one word in ``share`` is hit."""
    return (F.col(f"{prefix}n_hit") > 0) & (F.col(f"{prefix}n_hit") * share >= F.col(f"{prefix}n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", share: int = 20, **kw) -> DataFrame:
    """Drop contaminated documents, and cut the hit passages out of the others; same columns as ``docs``."""
    own, _, names = own_names(docs)
    found = find_contamination(own, benchmark, text_col=names[text_col], **kw).where(~is_contaminated(share))
    text, spans = F.col(names[text_col]), F.col("spans")
    cut = F.aggregate(
        spans,
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda s, x: F.struct(F.concat(s["text"], F.substring(text, s["at"] + 1, x["start"] - s["at"])).alias("text"), x["end"].alias("at")),
        lambda s: F.concat(s["text"], F.substring(text, s["at"] + 1, F.length(text))),
    )
    new = F.when(F.size(spans) > 0, cut).otherwise(text)
    return found.select(*[(new if c == text_col else F.col(n)).alias(c) for c, n in names.items()])
