"""Line dedup, near-duplicates, decontamination, mixing and quality against brute force."""

import random
import re

import numpy as np
import pandas as pd
import pytest
import support
from hostile_rows import hostile, own_values
from pyspark.sql import functions as F

from tessera.llm import decontaminate, linededup, mixing, neardup, quality

WORDS = "river stone cloud paper light garden window market silver winter butter candle forest bridge copper yellow".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


def edit_within_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(2)
    base = [prose(rng, 4) for _ in range(12)] + ["x" * 600, "short", "", "  ", "é日本" * 12]
    def changed(s):
        i = rng.randrange(len(s) + 1)
        return rng.choice((s, s[:i] + "#" + s[i:], s[:i] + s[i + 1 :], s[:i] + "#" + s[i + 1 :]))
    texts = ["\n".join(changed(rng.choice(base)) for _ in range(rng.randint(1, 6))) for _ in range(40)] + ["", None, "\n\n", base[0]]
    got = {r["doc_id"]: r for r in linededup.dedup_lines(hostile(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    first, spots = {}, []
    for i, t in enumerate(texts):
        for no, line in enumerate((t or "").split("\n")):
            if line.strip(" "):
                first.setdefault(line, (i, no))
                spots.append((i, no, line))
    near = {b for b in first if len(b) >= 20 and any(len(a) >= 20 and a != b and first[a] < first[b] and edit_within_one(a, b) for a in first)}
    gone = {(i, no) for i, no, line in spots if line in near or first[line] != (i, no)}
    for i, t in enumerate(texts):
        want = None if t is None else "\n".join(x for no, x in enumerate(t.split("\n")) if (i, no) not in gone)
        assert got[i]["text"] == want and own_values(got[i], but=("_n_gone",)) == i
        assert got[i]["_n_gone"] == sum(a == i for a, _ in gone)
    assert len(gone) > 30


def test_line_dedup_of_short_and_long_lines(spark):
    """``min_chars`` off: lines of few characters, of several bytes each; and lines of thousands, changed at every part."""
    rng = random.Random(4)
    long = [prose(rng, 700), "é" * 1500 + prose(rng, 200) + "日本語" * 400]
    short = ["a", "b", "é", "日", "𝄞", "ab", "aé", "日é", "x y", "x\ty", "\t", "  ", ""]
    changed = [s[:i] + c + s[i + d :] for s in long for i in (0, 1, 255, 256, 257, len(s) // 4, len(s) // 2, 3 * len(s) // 4, len(s) - 1, len(s)) for c, d in (("𝄞", 0), ("", 1), ("z", 1), ("ß", 1))]
    texts = [rng.choice(long)] + ["\n".join(rng.sample(short, 3)) for _ in range(12)] + rng.sample(changed, len(changed))
    got = {r["id"]: set(r["gone"]) for r in linededup.dropped_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), min_chars=0).collect()}
    first, want = {}, {}
    spots = [(i, no, line) for i, t in enumerate(texts) for no, line in enumerate(t.split("\n")) if line.strip(" ")]
    for i, no, line in spots:
        first.setdefault(line, (i, no))
    near = {b for b in first if any(abs(len(a) - len(b)) <= 1 and first[a] < first[b] and edit_within_one(a, b) for a in first)}
    for i, no, line in spots:
        if line in near or first[line] != (i, no):
            want.setdefault(i, set()).add(no)
    assert got == want and len(near) > 30


def test_line_dedup_edges(spark):
    line = "a line that is long enough to count"
    rows = [(None, line, "s"), (5, line, "s"), (5, line, "s"), (5, "own " + prose(random.Random(3), 5), "s"), (7, f"{line}\nrest of the document here", "s"), (8, line, "s")]
    kept = sorted(((r["doc_id"], r["text"]) for r in linededup.keep_new_text(hostile(spark, rows)).collect()), key=str)
    assert kept == sorted([(None, line), (5, rows[3][1]), (7, "rest of the document here")], key=str)
    assert linededup.dedup_lines(hostile(spark, rows).limit(0)).count() == 0


def sets(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute_components(rows, n, percent):
    s = [sets(t, n) for _, t in rows]
    root = list(range(len(rows)))
    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def near_texts(rng):
    out = []
    for _ in range(8):
        words = prose(rng, rng.choice((2, 40, 120, 300))).split()
        out.append(" ".join(words))
        for _ in range(rng.randint(1, 5)):
            words = list(words)  # chains: each copy departs from the one before
            for _ in range(max(1, len(words) // 60)):
                words[rng.randrange(len(words))] = "changed" + str(rng.randrange(9))
            out.append(" ".join(words).upper() if rng.random() < 0.2 else "\t".join(words))
    return out


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(6)
    texts = near_texts(rng) + ["", None, " \n", "one", "ONE", "one two", " one", prose(rng, 9000)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.components(hostile(spark, [(i, t, "s") for i, t in rows]), words=3, percent=85).collect())
    want = brute_components(rows, 3, 85)
    assert got == want and len({c for _, _, c in want}) < len(rows) - 8
    kept = neardup.keep_first(hostile(spark, [(i, t, "s") for i, t in rows]), words=3, percent=85).collect()
    assert sorted(r["doc_id"] for r in kept) == [d for d, _, c in want if d == c] and all(own_values(r) == r["doc_id"] for r in kept)


def test_near_duplicates_with_repeated_ids(spark):
    rng = random.Random(7)
    a, b, c = prose(rng, 60), prose(rng, 60), prose(rng, 60)
    rows = [(1, a, "s"), (3, a, "s"), (3, b, "s"), (4, c, "s"), (4, c, "s"), (None, a, "s"), (None, b, "s"), (5, "", "s"), (5, "", "s"), (6, None, "s")]
    kept = sorted(((r["doc_id"], r["text"]) for r in neardup.keep_first(hostile(spark, rows)).collect()), key=str)
    assert kept == sorted([(1, a), (3, b), (4, c), (5, ""), (5, ""), (6, None)], key=str)
    assert neardup.keep_first(hostile(spark, rows).limit(0)).count() == 0


def test_large_bucket_of_chains(spark):
    """A bucket's members that its chosen ones do not link are compared in blocks; no link is lost."""
    rng = random.Random(9)
    frame, texts = prose(rng, 200).split(), []
    for _ in range(60):
        w = list(frame)
        for i in rng.sample(range(200), 7):
            w[i] = f"own{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.components(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=70).collect())
    assert got == brute_components(rows, 3, 70)


def test_blocks_lose_no_pair_whatever_the_order_of_rows():
    """One bucket dealt into blocks of about 8 as ``components`` deals it; each cell's rows come in an order of its own."""
    rng = random.Random(12)
    base = prose(rng, 120).split()
    texts = [" ".join([*base[:60], *(f"own{k // 2}x{i}" for i in range(60)), f"last{k}"]) for k in range(64)]
    z = [neardup.shingles(t.encode(), 3) for t in texts]
    cids = [neardup.class_id(x) for x in z]
    sig = neardup.signature(z[0]).tobytes()  # one signature for all: every pair is plausible, and first shares band 0
    main, n = cids[0], 8
    rows = pd.DataFrame({"cid": cids, "comp": cids, "text": texts, "sig": [sig] * 64, "outside": [c != main for c in cids], "at": [rng.randrange(n) for _ in cids], "to": [rng.randrange(n) for _ in cids]})
    run, got = neardup._block(3, 80, neardup.least_agreement(0.8)), []
    for i in range(n):
        for j in range(n):
            left = rows[rows["outside"] & (rows["at"] == i)].assign(side=0)
            right = rows[rows["to"] == j].assign(side=1)
            cell = pd.concat([left, right]).assign(band=0).sample(frac=1, random_state=n * i + j)
            got += run(cell).itertuples(index=False, name=None)
    pairs = [tuple(sorted((cids.index(a), cids.index(b)))) for a, b in got]
    assert set(pairs) == {(k, k + 1) for k in range(0, 64, 2)}  # none is lost
    assert len(pairs) == 32  # and none is looked at twice


def test_bayesian_bounds():
    least = neardup.least_agreement(0.85)
    assert least[0] == 0 and all(a <= b <= a + 1 for a, b in zip(least, least[1:], strict=False))
    rng = np.random.default_rng(1)
    agreed = np.cumsum(rng.random((20_000, neardup.HASHES)) < 0.85, axis=1)
    lost = np.zeros(20_000, bool)
    for n in range(neardup.BATCH, neardup.HASHES + 1, neardup.BATCH):
        lost |= agreed[:, n - 1] < least[n]
    assert lost.mean() < 1e-3  # a pair right at the threshold


def brute_hits(text, items, n=13):
    words = [w.lower() if w.isascii() else re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    hit, found = set(), set()
    for item, t in items:
        own = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
        for w in {tuple(own[i : i + n]) for i in range(max(1, len(own) - n + 1))} if own else ():
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    found.add(str(item) if item is not None else "")
    return len(words), len(hit), sorted(found)


def test_decontamination_against_brute_force(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, rng.choice((1, 5, 13, 14, 30)))) for i in range(12)] + [(20, None), (21, ""), (22, "é Ünï"), (None, "Odd Item"), (3, "same id, other text"), (23, "a a"), (24, "a")]
    texts = [None, "", "...", "É ÜNÏ é Ünï", "a a a b a"]
    for _ in range(40):
        passage = rng.choice(items)[1] or ""
        texts.append(f"{prose(rng, rng.randrange(60))}; {passage.upper() if rng.random() < 0.3 else passage.replace(' ', ', ')} -- {prose(rng, rng.randrange(300))}")
    docs = hostile(spark, [(i, t, "s") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(t, items) for i, t in enumerate(texts)}
    for block in (decontaminate.BLOCK_BYTES, 200):
        got = {r["doc_id"]: r for r in decontaminate.find_contamination(docs, bench, block_bytes=block).collect()}
        assert {i: (r["n_words"], r["n_hit"], r["items"]) for i, r in got.items()} == want
    for i, r in got.items():
        assert sum(len(decontaminate.normal_words(texts[i][s["start"] : s["end"]].encode())) for s in r["spans"]) == r["n_hit"]
    kept = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench).collect()}
    assert set(kept) == {i for i, (n, h, _) in want.items() if not (h and 20 * h >= n)}
    for i, r in kept.items():
        assert own_values(r) == i and (brute_hits(r["text"], items)[0] == want[i][0] - want[i][1])
    assert decontaminate.find_contamination(docs, bench.limit(0)).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontaminate.find_contamination(docs.limit(0), bench).count() == 0


def test_fit_against_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        sizes = np.sort(rng.choice(np.arange(1, 30), 5, replace=False))
        counts = rng.integers(1, 4, 5)
        budget = int(rng.integers(0, (sizes * counts).sum() + 5))
        take = mixing.fit(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        reach = {0}
        for s, c in zip(sizes, counts, strict=True):
            reach = {r + k * s for r in reach for k in range(c + 1)}
        got, best = int((take * sizes).sum()), max(r for r in reach if r <= budget)
        assert got <= budget and best - got <= 2 * sizes[-1]
    assert mixing.fit(np.array([2, 3]), np.array([5, 5]), 11).sum() > 0


def test_mix(spark):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randint(1, 60)), rng.choice(["a", "b", "b", "b", "b", "c", None])) for i in range(300)]
    rows += [(900, None, "a"), (901, "", "z"), (902, "x y", "b"), (902, "x y", "b"), (None, "p q r", "c")]
    df = hostile(spark, rows)
    got = mixing.mix(df).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(df.repartition(7)).collect()), key=str)  # reruns agree
    size, taken, target = {}, {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        target[r["source"]] = r["target"]
    assert len(got) == len(rows) and target["z"] == 0
    order, weight = ["a", "b", "c", "z", None], {"a": 3, "b": 1, "c": 2, "z": 3, None: 1}
    lo, hi = 0.0, 1e9  # water filling by bisection
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * size[s], weight[s] * mid) for s in order) < 1.5 * sum(size.values()) else (lo, mid)
    for s in order:
        assert target[s] == pytest.approx(min(2 * size[s], weight[s] * lo), abs=1e-3) and abs(taken[s] - target[s]) <= max(2, 0.01 * target[s])
    out = mixing.take(df).collect()
    assert sum(r["taken"] for r in out) == sum(taken.values()) and all(r["copies"] * r["size"] == r["taken"] > 0 for r in out)
    assert all(r["row"] == r["gone"].replace("gone", "row") for r in out)
    assert mixing.take(df.limit(0)).count() == 0


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"{support.DATA.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.unionByName(spark.createDataFrame([(None, 1, 0), (1, None, 0), (10**9, 1, 1)], labels.schema)))
    got = quality.score(docs, model).join(labels, "doc_id").select("doc_id", "score", "quality", quality.held_out(F.col("doc_id")).alias("held")).collect()
    held = [r for r in got if r["held"] and r["quality"] is not None]
    import zlib

    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) == r["held"] for r in got)
    good, bad = [r["score"] for r in held if r["quality"]], [r["score"] for r in held if not r["quality"]]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    right = np.mean([(r["score"] >= 0.3) == r["quality"] for r in held])
    assert auc > 0.97 and right > 0.9
    assert np.mean([s >= 0.3 for s in good]) > 0.97  # good documents stay
    odd = hostile(spark, [(1, None, "s"), (2, "", "s"), (3, "\x01 " * 50, "s"), (4, "wort" * 20_000, "s"), (4, "wort" * 20_000, "s")])
    scores = [r["score"] for r in quality.score(odd, model).collect()]
    assert scores[0] == scores[1] and scores[3] == scores[4] and all(0 <= s <= 1 for s in scores)
    kept = quality.keep_good(odd, model, least=0.0).collect()
    assert [own_values(r) for r in kept] == [0, 1, 2, 3, 4]
    untrained = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(odd, untrained).collect()} == {0.5}


def test_the_sample_bounds_texts_and_features(spark, monkeypatch):
    rng, seen = random.Random(8), []
    docs = spark.createDataFrame([(1, prose(rng, 40)) for _ in range(300)] + [(2, prose(rng, 4000))], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "train", lambda rows, **kw: seen.append(rows))
    quality.fit(docs, labels, sample=7, most=50)
    quality.fit(docs.unionByName(docs), labels, sample=1000, most=50)
    assert [len(rows) for rows in seen] == [len(seen[0]), len(seen[1])] and len(seen[0]) <= 7 and len(seen[1]) <= 301
    for _, ids, share in seen[0] + seen[1]:
        assert len(ids) == len(set(ids.tolist())) <= 50 and share.sum() == pytest.approx(1, abs=1e-4)


def test_scores_do_not_depend_on_the_memo(monkeypatch):
    rng, weights = random.Random(5), np.random.default_rng(5).normal(size=quality.BUCKETS)
    texts = [prose(rng, 80).encode() + b" " + b"y" * 200 for _ in range(20)]
    full = [quality.Scorer(weights, 0.1)(t) for t in texts]
    monkeypatch.setattr(quality, "MEMO", 10)
    s = quality.Scorer(weights, 0.1)
    assert [s(t) for t in texts] == full
    for t, got in zip(texts, full, strict=True):
        ids, share = quality.document_features(t.decode())
        assert got == pytest.approx(quality.Model(weights, 0.1).score(float(weights[ids] @ share)), abs=1e-5) and share.sum() == pytest.approx(1, abs=1e-4)
