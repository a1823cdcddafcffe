"""MinHash near-duplicates with sequential Bayesian verification.

A document is the set of its distinct shingles of ``words`` consecutive words (a shorter one is a single
shingle). Documents with equal sets are one class. MinHash signatures of the classes are banded, and
classes that share a band are candidates. A candidate pair is compared batch by batch of its signatures;
after m of n hashes agree, it is pruned if the posterior probability (uniform prior) that the similarity
reaches the threshold is below ``miss``. Survivors are verified on the full sets, so no link is wrong.

No bucket is expanded into all its pairs. First, every member is compared with one of its bucket, another one
in each band, which takes as many pairs as there are members, and components are formed; so again, ``TURNS``
times, for members that are not in that one's component. Only buckets whose members are still in several
components remain; there, members outside the largest component are held against all others in blocks of
about ``BLOCK`` rows, whatever the bucket's size, and a block returns only links that join components. Links and components stay distributed.

Defined results: a null or empty text, or one of white space, has no shingles and is linked with nothing;
rows that repeat an id are rows of their own with that id; a null id is larger than any; equal texts are one
class; an empty table gives none. Columns other than id and text are ignored by ``components``, and
``keep_first`` returns the columns of its input, whatever their names. Of texts with one id, each is judged by itself,
and of rows that repeat both, one stays; rows without shingles all stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, maybe_in, own_names, small_batches

BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
BATCH, MISS = 25, 1e-5
BLOCK = 256
#: Times that a bucket's members are compared with one of them.
TURNS = 3
#: Words with a remembered hash; a full memo is emptied.
MEMO = 500_000
_RNG = np.random.default_rng(20_011)
FACTORS = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)
GOLDEN, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
#: Shingles that are hashed at a time, to bound memory for very long texts.
CHUNK = 4096


class _Memo(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = value
        return value


_HASHED = _Memo()


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text in UTF-8; A-Z in lower case, white space as in ASCII."""
    w = (text or b"").lower().split()
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASHED.__getitem__, w), np.uint64, len(w))
    n = min(words, len(w))
    z = np.full(len(w) - n + 1, np.uint64(n))
    for k in range(n):
        z = (z ^ h[k : len(w) - n + 1 + k]) * GOLDEN
        z ^= z >> np.uint64(29)
    z *= MIX
    z ^= z >> np.uint64(32)
    return np.unique(z)


def signature(z: np.ndarray) -> np.ndarray:
    """HASHES minima, of the upper 32 bits of an affine map."""
    out = np.full(HASHES, np.uint32(0xFFFFFFFF))
    for i in range(0, len(z), CHUNK):
        np.minimum(out, (((z[i : i + CHUNK, None] * FACTORS + SHIFTS) >> np.uint64(32)).astype(np.uint32)).min(0), out=out)
    return out


def bands(sig: np.ndarray) -> list[int]:
    raw = sig.tobytes()
    size = 4 * ROWS
    return [xxhash.xxh3_64_intdigest(raw[i * size : (i + 1) * size], seed=i) - (1 << 63) for i in range(BANDS)]


def class_id(z: np.ndarray) -> bytes:
    return hashlib.md5(z.tobytes()).digest()


def least_agreement(threshold: float, miss: float = MISS) -> list[int]:
    """For each number n of hashes compared, the fewest that must agree: P(J >= t | m of n) = P(Bin(n + 1, t) <= m)."""
    out = []
    for n in range(HASHES + 1):
        total = 0.0
        for m in range(n + 1):
            total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
        out.append(m)
    return out


def plausible(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Row by row: whether signatures a and b survive every batch."""
    alive = np.arange(len(a))
    agreed = np.zeros(len(a), np.int32)
    for n in range(BATCH, HASHES + 1, BATCH):
        agreed[alive] += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(1).astype(np.int32)
        alive = alive[agreed[alive] >= least[n]]
        if not len(alive):
            break
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exactly: 100 * |a & b| >= percent * |a | b|."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _raw(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    return batch.column(name).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()


def _features(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, keys = [], [], []
            for text in _raw(batch, "text"):
                z = shingles(text, words)
                n.append(len(z))
                ids.append(class_id(z) if len(z) else None)
                keys.append(bands(signature(z)) if len(z) else [])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "row", "n_shingles", "cid", "bands"])

    return run


def _candidates(words: int):
    """(cid, text, sig) of the documents that are in some bucket with others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sigs = [], []
            for text in _raw(batch, "text"):
                z = shingles(text, words)
                ids.append(class_id(z))
                sigs.append(signature(z).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), batch.column("text"), pa.array(sigs, pa.binary())], names=["cid", "text", "sig"])

    return run


class _Sets:
    """Shingle sets of the texts of a block or batch, made when first needed; emptied at MOST shingles."""

    MOST = 8_000_000

    def __init__(self, words: int):
        self.words, self.kept, self.size = words, {}, 0

    def __call__(self, cid: bytes, text: str) -> np.ndarray:
        z = self.kept.get(cid)
        if z is None:
            z = shingles(text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text, self.words)
            if self.size + len(z) > self.MOST:
                self.kept.clear()
                self.size = 0
            self.kept[cid] = z
            self.size += len(z)
        return z


def _verify(words: int, percent: int, least: list[int]):
    """Pairs with both signatures and texts; those that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = _Sets(words)
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
            ok = np.flatnonzero(plausible(a, b, least))
            ca, cb = batch.column("a"), batch.column("b")
            ta, tb = batch.column("text_a"), batch.column("text_b")
            got = [i for i in ok.tolist() if linked(sets(ca[i].as_py(), ta[i].as_py()), sets(cb[i].as_py(), tb[i].as_py()), percent)]
            take = pa.array(got, pa.int64())
            yield pa.RecordBatch.from_arrays([ca.take(take), cb.take(take)], names=["a", "b"])

    return run


def _block(words: int, percent: int, least: list[int]):
    """Links that join components between the left and the right rows of a block of one bucket.

    A pair is looked at in the first band that it shares only, so buckets don't repeat each other's work. Two
    members outside the largest component meet in two blocks, once each as the left one; the block with the smaller
    id on the left looks at them, whatever the order of rows.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sets = _Sets(words)
        band = int(rows["band"].iloc[0])
        left, right = rows[rows["side"] == 0], rows[rows["side"] == 1]
        out: list[tuple[bytes, bytes]] = []
        if len(left) and len(right):
            root: dict[bytes, bytes] = {}

            def find(x: bytes) -> bytes:
                while root.get(x, x) != x:
                    root[x] = x = root.get(root[x], root[x])
                return x

            sig = {s: np.frombuffer(b"".join(f["sig"]), np.uint32).reshape(-1, HASHES) for s, f in ((0, left), (1, right))}
            lc, rc, lt, rt, lp, rp = (f[c].tolist() for c in ("cid", "text", "comp") for f in (left, right))
            outside = right["outside"].tolist()
            for j in range(len(right)):
                ok = plausible(sig[0], np.broadcast_to(sig[1][j], sig[0].shape), least)
                for i in np.flatnonzero(ok).tolist():
                    if lc[i] == rc[j] or find(lp[i]) == find(rp[j]) or outside[j] and rc[j] < lc[i]:
                        continue
                    same = (sig[0][i] == sig[1][j]).reshape(BANDS, ROWS).all(1)
                    if int(same.argmax()) == band and linked(sets(lc[i], lt[i]), sets(rc[j], rt[j]), percent):
                        root[find(lp[i])] = find(rp[j])
                        out.append((lc[i], rc[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype=object)

    return run


def label(links: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(cid, comp) of every node of links (a, b): comp is the smallest node reachable.

    Alternating large and small stars; each round writes its edges, until one leaves them as they were. A hub's edges
    are grouped with partial minima; where they are joined to their minimum, a hub is a skewed key on one side only, which Spark splits.
    """
    def star(edges: DataFrame, large: bool, name: str) -> DataFrame:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        side = both.where(F.col("b") > F.col("a")) if large else both.where(F.col("b") < F.col("a"))
        moved = side.join(lows, side["a"] == lows["u"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = moved.unionByName(lows.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return scratch.write(moved.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)

    def seen(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())

    edges = scratch.write(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    was = seen(edges)
    for _ in range(rounds):
        if not was[0]:
            break
        large = star(edges, True, "large")
        small = star(large, False, "small")
        scratch.drop(edges, large)
        edges = small
        now = seen(edges)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("cid"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("cid"), F.col("b").alias("comp")).distinct())


def components(docs: DataFrame, *, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, component) for every row; row is a hash that tells texts with one id apart,
    component the class that names the component, null without shingles."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch, least = Scratch(spark, "neardup"), least_agreement(percent / 100, miss)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    found = scratch.write(source.withColumn("row", F.xxhash64("text")).mapInArrow(_features(words), f"doc_id {kind}, row long, n_shingles long, cid binary, bands array<long>"), "features")
    classes = scratch.write(found.where(F.col("cid").isNotNull()).groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    banded = classes.select("cid", F.posexplode("bands").alias("band", "h"))
    buckets = scratch.write(banded.groupBy("band", "h").agg(F.count("*").alias("n")).where(F.col("n") > 1), "buckets")
    shared = maybe_in(banded.withColumn("_key", F.xxhash64("band", "h")), F.col("_key"), buckets, F.xxhash64("band", "h"))
    members = scratch.write(shared.drop("_key").join(buckets, ["band", "h"]), "members")
    wanted = scratch.write(classes.select("cid", "rep").join(members.select("cid").distinct(), "cid").select(F.col("rep").alias("_rep")).distinct(), "wanted")
    text = maybe_in(source, F.col("doc_id"), wanted, F.col("_rep")).join(wanted, F.col("doc_id").eqNullSafe(F.col("_rep"))).select("text")
    text = scratch.write(text.mapInArrow(_candidates(words), "cid binary, text string, sig binary").dropDuplicates(["cid"]), "candidates")
    a = text.select(F.col("cid").alias("a"), F.col("text").alias("text_a"), F.col("sig").alias("sig_a"))
    b = text.select(F.col("cid").alias("b"), F.col("text").alias("text_b"), F.col("sig").alias("sig_b"))

    def with_buckets(rows: DataFrame, of: DataFrame) -> DataFrame:
        """``rows`` with what ``of`` says of their bucket; a bucket is dealt out in shares of about BLOCK rows."""
        shares = F.ceil(F.col("n") / F.lit(float(BLOCK))).cast("int")
        each = of.withColumn("_share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("n")
        return rows.withColumn("_share", F.pmod(F.xxhash64(F.lit(3), "cid"), shares).cast("int")).join(each, ["band", "h", "_share"]).drop("_share")

    def star(rows: DataFrame, turn: int) -> DataFrame:
        """Links of each bucket's members with one of them, another one in each band and turn."""
        pick = rows.groupBy("band", "h").agg(F.min_by(F.struct("cid", "comp"), F.xxhash64(F.lit(turn), "band", "cid")).alias("pivot"), F.max("n").alias("n"))
        met = with_buckets(rows, pick).where(F.col("comp") != F.col("pivot")["comp"])
        pairs = met.select(F.least("cid", F.col("pivot")["cid"]).alias("a"), F.greatest("cid", F.col("pivot")["cid"]).alias("b")).distinct()
        return scratch.write(pairs.join(b, "b").join(a, "a").mapInArrow(_verify(words, percent, least), "a binary, b binary"), f"stars{turn}")

    def mixed(comp: DataFrame) -> DataFrame:
        """Members of buckets of three or more whose members are in several components; main: the largest there."""
        placed = members.where(F.col("n") > 2).join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        parts = placed.groupBy("band", "h", "comp").agg(F.count("*").alias("c"), F.max("n").alias("n"))
        several = parts.groupBy("band", "h").agg(F.count("*").alias("parts"), F.max_by("comp", "c").alias("main"), F.max("n").alias("n")).where(F.col("parts") > 1)
        return scratch.write(with_buckets(placed, several.select("band", "h", "main", "n")), "mixed")

    def joined(comp: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """``comp`` after some more links."""
        return scratch.write(label(comp.select(F.col("cid").alias("a"), F.col("comp").alias("b")).unionByName(links), scratch), name)

    comp = scratch.write(label(star(members.withColumn("comp", F.col("cid")), 0), scratch), "components")
    open_ = mixed(comp)
    for turn in range(1, TURNS):
        links = star(open_, turn)
        if not links.isEmpty():  # else components are as they were, and so is what is mixed
            comp = joined(comp, links, "components")
            open_ = mixed(comp)
    outside = F.col("comp") != F.col("main")
    sizes = open_.groupBy("band", "h").agg(F.count_if(outside).alias("lefts"), F.count("*").alias("rights")).where((F.col("lefts") > 0) & (F.col("rights") > 1))
    blocks = lambda c: F.ceil(F.col(c) / F.lit(float(BLOCK))).cast("int")
    own = lambda c: F.pmod(F.xxhash64("cid"), blocks(c)).cast("int")
    rest = open_.join(sizes, ["band", "h"])
    lefts = rest.where(outside).select("cid", "comp", "band", "h", own("lefts").alias("i"), F.explode(F.sequence(F.lit(0), blocks("rights") - 1)).alias("j"), F.lit(0).alias("side"), outside.alias("outside"))
    rights = rest.select("cid", "comp", "band", "h", F.explode(F.sequence(F.lit(0), blocks("lefts") - 1)).alias("i"), own("rights").alias("j"), F.lit(1).alias("side"), outside.alias("outside"))
    dealt = lefts.unionByName(rights).join(text, "cid")
    more = scratch.write(dealt.groupBy("band", "h", "i", "j").applyInPandas(_block(words, percent, least), "a binary, b binary"), "rest")
    if not more.isEmpty():
        comp = joined(comp, more, "components2")
    named = classes.select("cid", "rep").join(comp, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    first = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_class = named.join(first, "comp").select(F.col("cid").alias("_cid"), "component_id", F.col("comp").alias("component"))
    scratch.drop(buckets, members, wanted, text, more, open_)
    out = found.select("doc_id", "row", "n_shingles", "cid").join(by_class, F.col("cid") == F.col("_cid"), "left")
    return out.select("doc_id", "row", "n_shingles", F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "component")


def keep_first(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Documents that are the first of their component, by id and then by a hash of the text."""
    scratch = Scratch(docs.sparkSession, "keep")
    found = scratch.write(components(docs, id_col=id_col, text_col=text_col, **kw).where(F.col("component").isNotNull()).select("doc_id", "row", "component"), "found")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    first = found.groupBy("component").agg(F.min(place).alias("first"))
    by = found.join(first, "component").withColumn("is_first", place == F.col("first"))
    gone = scratch.write(by.where(~F.col("is_first")).select(F.col("doc_id").alias("_gone"), F.col("row").alias("_text")).distinct(), "gone")
    again = scratch.write(by.where("is_first").groupBy("doc_id", "row").count().where("count > 1").select(F.col("doc_id").alias("_gone"), F.col("row").alias("_text")), "again")
    own, back, names = own_names(docs)
    own = own.withColumn("_row", F.xxhash64(F.col(names[text_col]).cast("string")))
    same = F.col(names[id_col]).eqNullSafe(F.col("_gone")) & (F.col("_row") == F.col("_text"))
    kept = own.join(gone, same, "left_anti")
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").unionByName(own.join(again, same, "left_semi").dropDuplicates([names[id_col], "_row"]))
    return kept.select(*back)
