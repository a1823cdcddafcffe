"""Quality classifier: supervised subword embeddings.

Words (runs without white space) and their character n-grams, with word boundaries marked, are hashed to
``BUCKETS`` learned vectors; a document is the average of its vectors; a softmax layer gives the label.
Training is stochastic gradient descent in numpy, one document at a time, on a bounded sample of labelled
documents (``sample`` rows of text and label, with the smallest seeded hash of their id; 6,000 unless stated), from
which the executors send only hashed features: of a document with more than ``most`` distinct ones (8,192 unless
stated) those with the smallest seeded hash, wherever they are in the text. They lie in a temporary file of the driver. Both bounds hold for training alone. As the average and the layer are linear, a trained model scores a
word by one number, which a worker remembers for up to ``MEMO`` words.

Defined results: null and empty texts have no features and get the score of the bias alone; a document of
which there are several labels is trained on with each, and texts that share an id with each, repeats once; null labels and ids are not trained on; without
any label every score is 0.5. Rows that repeat are scored one by one; an empty table gives none.
"""

from __future__ import annotations

import mmap
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import own_names, small_batches

BUCKETS, DIM = 1 << 17, 16
GRAMS = (2, 3, 4)
SAMPLE, MOST, EPOCHS, RATE, SEED = 6_000, 8_192, 8, 0.4, 11
MEMO = 300_000
#: Of a longer word the n-grams are taken like those of any other, but nothing is remembered.
MEMO_LENGTH = 64
#: Words whose n-grams are hashed at a time.
CHUNK = 4096


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of words and of their n-grams of characters between boundary marks, and the index of each one's word."""
    text = [w.decode("utf-8", "surrogatepass") for w in words]
    size = np.fromiter(map(len, text), np.int64, len(words)) + 2
    raw = np.frombuffer(("".join([f"\x01{w}\x02" for w in text]) + "\0" * max(GRAMS)).encode("utf-32-le", "surrogatepass"), np.uint32)
    n, owner = len(raw) - max(GRAMS), np.repeat(np.arange(len(words)), size)
    room = np.repeat(np.cumsum(size), size) - np.arange(n)  # characters up to the word's end
    found, owners = [np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))], [np.arange(len(words))]
    for g in GRAMS:
        fits = room >= g
        code = sum(raw[k : k + n] * np.uint32(0x01000193**k & 0xFFFFFFFF) for k in range(g))[fits]
        code = (code ^ np.uint32(g * 0x3C6EF372)) * np.uint32(0x9E3779B1)
        found.append((code ^ (code >> np.uint32(15))) * np.uint32(0x85EBCA77))
        owners.append(owner[fits])
    return np.concatenate(found) >> np.uint32(32 - BUCKETS.bit_length() + 1), np.concatenate(owners)


def document_features(text: str | None, most: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets, ``most`` of them, and their shares."""
    counted = Counter((text or "").encode("utf-8", "surrogatepass").split())
    if not counted:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    buckets, owners = features(list(counted))
    n = np.bincount(buckets, np.fromiter(counted.values(), np.float64, len(counted))[owners], BUCKETS)
    ids = np.flatnonzero(n)
    if len(ids) > most:
        ids = np.sort(ids[np.argsort((ids.astype(np.uint32) ^ np.uint32(SEED)) * np.uint32(0x9E3779B1), kind="stable")[:most]])
        n = np.bincount(ids, n[ids], BUCKETS)
    return ids.astype(np.int32), (n[ids] / n.sum()).astype(np.float32)


class Model:
    """Bucket weights towards label 1 against label 0, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, mean: float) -> float:
        return float(1.0 / (1.0 + np.exp(-np.clip(mean + self.bias, -50, 50))))


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], *, epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """rows: label 0 or 1, buckets, shares. Vectors start as small noise, the layer at zero.

    A rate at which the weights overflow is halved, and training starts anew.
    """
    while True:
        with np.errstate(all="ignore"):
            model = _descend(rows, epochs, rate, seed)
        if np.isfinite(model.weights).all() and np.isfinite(model.bias):
            return model
        rate /= 2


def _descend(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int, rate: float, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    vectors = rng.random((BUCKETS, DIM), np.float32)
    vectors -= 0.5  # in place, without copies
    vectors /= DIM
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            label, ids, share = rows[k]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            own = vectors[ids]
            hidden = share @ own if len(ids) else np.zeros(DIM, np.float32)
            z = layer @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = p @ layer
            layer -= lr * np.outer(p, hidden)
            bias -= lr * p
            if len(ids):
                # divided by the sum of squares, a step moves the document's average by the rate times its gradient,
                # however many features share it and however unequally
                vectors[ids] = own - (lr / np.dot(share, share) * share)[:, None] * back[None, :]
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float64), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, in fifths; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, most: int = MOST, **kw) -> Model:
    """Learn from at most ``sample`` labelled texts that are not held out."""
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_label")).where(F.col("_id").isNotNull() & F.col("_label").isin(0, 1) & ~held_out(F.col("_id")))
    chosen = chosen.orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id", "_label").limit(sample)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text")).withColumn("_row", F.xxhash64("_text"))
    met = texts.select("_id", "_row").join(F.broadcast(chosen), "_id").distinct()  # `sample` rows at most are broadcast; an id can have many texts
    met = met.orderBy(F.xxhash64(F.lit(SEED), "_id"), "_id", "_row", "_label").limit(sample)
    found = texts.join(F.broadcast(met), ["_id", "_row"]).dropDuplicates(["_id", "_row", "_label"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [document_features(t, most) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), pa.array([x.tobytes() for x, _ in got], pa.binary()), pa.array([x.tobytes() for _, x in got], pa.binary())], names=[*key, "ids", "share"])

    key = ["_id", "_label", "_row"]
    schema = found.select(*key).schema.add("ids", "binary").add("share", "binary")
    rows, at = [], 0
    with tempfile.TemporaryFile() as kept:  # the features lie in a file, filled as far as there are any: training needs one text's at a time
        kept.truncate(max(8, 8 * sample * most))
        room = mmap.mmap(kept.fileno(), 0)
        ids, share = np.frombuffer(room, np.int32)[: sample * most], np.frombuffer(room, np.float32)[sample * most :]
        for r in found.select(*key, "_text").mapInArrow(run, schema).toLocalIterator():
            n = len(r["ids"]) // 4
            ids[at : at + n], share[at : at + n] = np.frombuffer(r["ids"], np.int32), np.frombuffer(r["share"], np.float32)
            rows.append((r["_id"], r["_label"], r["_row"], at, at + n))
            at += n
    rows.sort()
    return train([(label, ids[i:j], share[i:j]) for _, label, _, i, j in rows], **kw)


class Scorer:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.model, self.memo = weights, Model(weights, bias), {}

    def learn(self, words: list[bytes]) -> dict[bytes, complex]:
        """Of each word the sum of its weights, and their number as the imaginary part."""
        buckets, owners = features(words)
        total, n = np.bincount(owners, self.weights[buckets], len(words)), np.bincount(owners, minlength=len(words))
        return dict(zip(words, (total + 1j * n).tolist(), strict=True))

    def __call__(self, text: str | bytes | None) -> float:
        words, memo = (text or b"").split(), self.memo
        new = [w for w in dict.fromkeys(words) if w not in memo]
        if len(memo) + len(new) > MEMO and memo:
            memo.clear()
            new = list(dict.fromkeys(words))
        for i in range(0, len(new), CHUNK):
            memo.update(self.learn(new[i : i + CHUNK]))
        total = sum(map(memo.__getitem__, words), 0j)
        for w in new:
            if len(w) > MEMO_LENGTH or len(memo) > MEMO:
                del memo[w]
        return self.model.score(total.real / total.imag if total.imag else 0.0)


_SCORERS: dict[str, Scorer] = {}


def _scorer(key: str, sent) -> Scorer:
    if key not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[key] = Scorer(*sent.value)
    return _SCORERS[key]


def score(docs: DataFrame, model: Model, *, text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (of them ``keep``, all columns unless stated) with a score from 0 to 1."""
    spark = docs.sparkSession
    small_batches(spark)
    sent, key = spark.sparkContext.broadcast((model.weights, model.bias)), uuid.uuid4().hex  # BUCKETS numbers
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() != score_col.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _scorer(key, sent)
        for batch in batches:
            raw = batch.column(text_col).cast(pa.large_string()).cast(pa.large_binary()).to_pylist()
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([scorer(t) for t in raw], pa.float64())], names=[*keep, score_col])

    return docs.select(*dict.fromkeys([*keep, text_col])).mapInArrow(run, T.StructType(docs.select(*keep).schema.fields + [T.StructField(score_col, T.DoubleType())]))


def keep_good(docs: DataFrame, model: Model, *, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with a score of ``least`` or more; same columns."""
    own, back, names = own_names(docs)
    return score(own, model, text_col=names[text_col]).where(F.col("score") >= least).select(*back)
