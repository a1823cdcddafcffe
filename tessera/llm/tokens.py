"""Token counts by count-only Viterbi segmentation under a unigram vocabulary.

A text is split into words at white space; each word, with the word mark before it, is segmented into the
pieces of highest summed score. An Aho-Corasick automaton over the vocabulary enumerates the pieces that
end at each character, longest first, and the dynamic program carries only the best score, the number
of pieces and whether the last one is unknown: no path is kept. Rules of the reference tokenizer
(`tokenizers.models.Unigram`), which tests hold the counts against: a path replaces another only by a
strictly higher score, with starts in ascending order; a character that is no piece of its own can be an
unknown piece, 10 below the lowest score; neighbouring unknown pieces count as one.

The unigram vocabulary is made from a public tokenizer's pieces, each scored by the logarithm of its Zipf
frequency, -ln(rank): no tokenizer is trained. Words repeat, so a worker remembers counts of up to
``MEMO`` words; a full memo is emptied, and results don't depend on it.

Defined results: null and empty texts have 0 tokens and 0 words; rows that repeat are counted one by one;
an empty table gives none. Input columns named like a result are replaced.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import small_batches, without

MARK = "▁"
#: White space as Unicode has it, for str.split's set also has 0x1C-0x1F.
NOT_SPACE = re.compile("[^\t-\r \x85\xa0  -     　]+")
MEMO = 400_000
#: Longer words are counted, but not remembered.
MEMO_LENGTH = 64
UNKNOWN_PENALTY = 10.0
TOKENIZERS = "/opt/tokenizers"
RESULTS = ("n_tokens", "n_words")


def vocabulary(path: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> list[tuple[str, float]]:
    """Pieces and scores; "<unk>" first, with id 0. The file's size bounds what is broadcast."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
    return [("<unk>", 0.0), *((p, -math.log(k + 2)) for k, p in enumerate(pieces))]


class Counter:
    """Counts pieces of a word; the memo is the only state."""

    def __init__(self, vocab: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for k, (p, score) in enumerate(vocab):
            self.automaton.add_word(p, (len(p), score, k == 0))
        self.empty = not vocab
        if not self.empty:
            self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocab), default=0.0) - UNKNOWN_PENALTY
        self.memo: dict[str, int] = {}

    def pieces(self, word: str) -> int:
        n = len(word)
        score, count, unk = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0  # ends up to here are final

        def gap(e: int) -> None:
            """End e has no piece of one character: the unknown piece is its last candidate."""
            s = score[e - 1] + self.unknown
            if not reached[e] or s > score[e]:
                score[e], count[e], unk[e], reached[e] = s, count[e - 1] + (not unk[e - 1]), True, True

        reached = [False] * (n + 1)
        single = [False] * (n + 1)
        for end, (length, piece_score, is_unk) in () if self.empty else self.automaton.iter(word):
            e = end + 1
            while done < end:
                done += 1
                if not single[done]:
                    gap(done)
            start = e - length
            s = piece_score + score[start]
            if not reached[e] or s > score[e]:
                score[e], count[e], unk[e], reached[e] = s, count[start] + (not (is_unk and unk[start])), is_unk, True
            if length == 1:
                single[e] = True
        while done < n:
            done += 1
            if not single[done]:
                gap(done)
        return count[n]

    def __call__(self, text: str) -> tuple[int, int]:
        memo, total, words = self.memo, 0, NOT_SPACE.findall(text)
        for w in words:
            n = memo.get(w)
            if n is None:
                n = self.pieces(MARK + w)
                if len(w) <= MEMO_LENGTH:
                    if len(memo) >= MEMO:
                        memo.clear()
                    memo[w] = n
            total += n
        return total, len(words)


_MADE: dict[str, Counter] = {}


def _counter(key: str, sent) -> Counter:
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Counter(sent.value)
    return _MADE[key]


def count_tokens(docs: DataFrame, *, text_col: str = "text", vocab: list[tuple[str, float]] | None = None, tokenizer: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """``docs`` with n_tokens and n_words; the text column itself is not returned unless it is kept by the
    caller's own columns."""
    spark = docs.sparkSession
    small_batches(spark)
    sent, key = spark.sparkContext.broadcast(vocabulary(tokenizer) if vocab is None else vocab), uuid.uuid4().hex
    docs = without(docs, *(r for r in RESULTS if r != text_col.lower()))
    keep = [c for c in docs.columns if c.lower() != text_col.lower()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(key, sent)
        for batch in batches:
            got = [counter(t) if t else (0, 0) for t in batch.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array([x for x, _ in got], pa.int64()), pa.array([x for _, x in got], pa.int64())], names=[*keep, *RESULTS])

    schema = docs.select(*keep).schema
    for name in RESULTS:
        schema.add(name, "long")
    return docs.mapInArrow(run, schema)
