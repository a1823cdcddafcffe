"""Hamming search, URL filter and token counts."""

import datetime
import random

import pytest

from tessera.llm import hamming, tokens, url_filter


def brute_top(rows, queries, k):
    rows = [(i, c) for i, c in rows if c is not None]
    dist = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))
    order = lambda i: (i is not None, i or 0)
    return {q: sorted(((dist(c, d), i) for i, d in rows if i != q), key=lambda x: (x[0], order(x[1])))[:k] for q, c in queries}


def test_top_k_against_brute_force(spark):
    rng = random.Random(1)
    base = [[rng.randrange(1 << 16) for _ in range(3)] for _ in range(6)]
    rows = [(i, rng.choice(base) if i % 3 else [x ^ (1 << rng.randrange(16)) for x in rng.choice(base)]) for i in range(80)]
    rows += [(100, [0, 0, 0]), (101, [65_535, 65_535, 65_535]), (102, None), (None, base[0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, code array<int>, query string")
    got = {}
    for r in hamming.top_k(df, df.where("vec_id in (0, 1, 2, 100, 101, 102)"), 7).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["distance"], r["neighbour_id"])
    want = brute_top(rows, [(i, c) for i, c in rows if i in (0, 1, 2, 100, 101)], 7)
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == want


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, code array<int>")
    assert hamming.top_k(df, df, 3).count() == 0


def test_url_filter(spark):
    day = lambda s: datetime.date.fromisoformat(s)
    entries = [("domain", "bad.org", "2024-01-10", "add"), ("domain", "bad.org", "2024-02-01", "remove"), ("host", "WWW.x.com", "2024-01-01", "add"), ("url", "http://ok.net/p#f", "2024-01-05", "add"), ("domain", "x.com", "2024-01-01", "add"), ("domain", "x.com", "2024-01-01", "add"), ("domain", None, "2024-01-01", "add"), ("domain", "same.day", "2024-01-01", "add"), ("domain", "same.day", "2024-01-01", "remove"), ("host", "[2001:db8::1]", "2024-01-01", "add")]
    captures = [
        ("http://a.b.bad.org/1", "2024-01-09", None), ("http://a.b.bad.org/1", "2024-01-10", "domain"), ("http://bad.org:80/", "2024-01-31", "domain"), ("http://bad.org/", "2024-02-01", None), ("http://notbad.org/", "2024-01-15", None),
        ("https://u@www.X.com./q", "2024-03-01", "host"), ("https://x.com", "2024-03-01", "domain"), ("http://ok.net/p", "2024-01-05", "url"), ("http://ok.net/p2", "2024-01-05", None), (None, "2024-01-05", None), ("no url", "2024-01-05", None), ("http://x.com", None, None), ("http://same.day/", "2024-06-01", None),
        ("HTTP://OK.net/p", "2024-01-05", "url"), ("http://ok.net/P", "2024-01-05", None), ("http://[2001:DB8::1]:80/", "2024-01-05", "host"), ("http://a.b.bad.org/1", "2024-01-10", "domain"), ("", "2024-01-05", None), ("http://" + "a." * 3000 + "bad.org/" + "x" * 50_000, "2024-01-11", "domain"),
    ]
    df = spark.createDataFrame([(i, u, d and day(d), f"h{i}") for i, (u, d, _) in enumerate(captures)], "i int, url string, fetched date, _host string")
    lists = spark.createDataFrame([(k, p, day(d), a) for k, p, d, a in entries], "kind string, pattern string, listed date, action string")
    got = url_filter.filter_urls(df, lists).orderBy("i").collect()
    assert [r["rule"] for r in got] == [x[2] for x in captures]
    assert all(r["_host"] == f"h{r['i']}" and r["blocked"] == (r["rule"] is not None) for r in got)
    assert url_filter.filter_urls(df, lists.limit(0)).where("blocked").count() == 0


def test_token_counts_against_the_tokenizer(spark):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocab = tokens.vocabulary()
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=False))
    t.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.Metaspace()])
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    rng = random.Random(4)
    texts += ["", " \t\n", "a", "日本語のテキスト", "\U0001f600\U0001f601 x\U0001f600", "x" * 5000, "<unk> a<unk>b <s>", "▁▁ ▁a", "a\x1cb c\x00d", "a b c", *("".join(rng.choices("abcd eé中�\U0001f600", k=60)) for _ in range(150))]
    df = spark.createDataFrame([(i, x, "k") for i, x in enumerate([*texts, None])], "doc_id long, text string, n_tokens string")
    got = {r["doc_id"]: (r["n_tokens"], r["n_words"]) for r in tokens.count_tokens(df).collect()}
    want = [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    assert [got[i][0] for i in range(len(texts))] == want
    assert got[len(texts)] == (0, 0) and got[texts.index("")] == (0, 0)


@pytest.mark.parametrize("limit", [3])
def test_memo_does_not_change_counts(monkeypatch, limit):
    monkeypatch.setattr(tokens, "MEMO", limit)
    c, text = tokens.Counter(tokens.vocabulary()), "the cat sat on the mat and the other cat sat too"
    small = c(text)
    monkeypatch.setattr(tokens, "MEMO", 10_000)
    assert tokens.Counter(tokens.vocabulary())(text) == small
