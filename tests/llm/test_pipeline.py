"""The stages one after the other: what each drops and keeps, and the columns."""

import mmap
import os
import random
import re

import numpy as np
import support
from hostile_rows import hostile, own_values
from test_documents import brute_components, brute_hits, edit_within_one, near_texts, prose

import corpus_pipeline
from tessera.llm import common, decontaminate, mixing, neardup, quality


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{support.DATA}/documents.parquet")
    bench = spark.read.parquet(f"{support.DATA}/benchmark.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert len(corpus_pipeline.STAGES) == 5
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{tmp_path}/{k}"
        stage(spark, docs, support.DATA).write.parquet(path)
        docs = spark.read.parquet(path)
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= before and len(after) > 0.5 * len(before), name
        assert docs.columns[: len(columns)] == columns if k < 4 else set(columns) < set(docs.columns)
        if name == "benchmark decontamination":
            assert decontaminate.find_contamination(docs, bench).where(decontaminate.is_contaminated()).count() == 0
            sizes = mixing.mix(docs)
        before = after
    assert docs.agg({"taken": "sum"}).first()[0] == sizes.agg({"taken": "sum"}).first()[0]


def kept_lines(docs):
    """Brute force: (id, text) less the lines that come again, up to one edit from 20 characters on."""
    first, spots = {}, []
    for i, text in docs:
        for no, line in enumerate((text or "").split("\n")):
            if line.strip(" "):
                first.setdefault(line, (i, no))
                spots.append((i, no, line))
    near = {b for b in first if len(b) >= 20 and any(len(a) >= 20 and first[a] < first[b] and edit_within_one(a, b) for a in first if a != b)}
    gone = {(i, no) for i, no, line in spots if line in near or first[line] != (i, no)}
    out = {}
    for i, text in docs:
        left = None if text is None else "\n".join(x for no, x in enumerate(text.split("\n")) if (i, no) not in gone)
        if left is None or left.strip(" \n") or not any(i == d for d, _ in gone):
            out[i] = left
    return out


def planted(rng):
    """Texts for each stage to act on, and clean ones; the benchmark; and labels."""
    sentence = lambda: prose(rng, 14)
    items = [prose(rng, 20) for _ in range(4)]
    texts = ["\n".join(sentence() for _ in range(rng.randint(4, 7))) for _ in range(60)]
    junk = [" ".join(rng.choice(("$$$", "click", "zzz9", "!!", "qqx")) for _ in range(40 + k)) for k in range(25)]
    lines = [texts[k] + "\n" + sentence() for k in range(6)]  # all lines but the last are known
    lines += [texts[k].replace("e", "#", 1) for k in range(6, 10)]  # a first line with one edit
    lines += [texts[10]]  # nothing is left of it
    near = []
    for k in range(20, 28):
        words = texts[k].split()
        words[rng.randrange(len(words))] = "changed"
        near.append(" ".join(words))  # other lines, so that only the near-duplicate stage finds it
    dirty = [f"{sentence()} {items[k]} {sentence()}" for k in range(4)]
    cut = [f"{prose(rng, 500)} {items[k].upper()} {prose(rng, 300)}" for k in range(2)]
    rest = lines + near + dirty + cut + [None, "", "one word", " \n "]
    rng.shuffle(rest)
    good = texts + rest
    rows = [(i, t, rng.choice(("a", "b", "b", "c", None))) for i, t in enumerate(good + junk)]
    labels = [(i, int(i < len(good)), 0) for i, t, _ in rows if t and (i % 2 == 0 or i >= len(good))]
    return rows, list(enumerate(items)), labels


def test_stages_against_brute_force(spark, tmp_path):
    rows, items, labels = planted(random.Random(21))
    hostile(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    tables, now, number = [], {i: t for i, t, _ in rows}, {i: k for k, (i, _, _) in enumerate(rows)}
    model = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    dropped = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        got = docs.collect()
        if k == 0:
            want = {}
            for i, t in now.items():
                ids, share = quality.document_features(t)
                if model.score(float(model.weights[ids] @ share)) >= 0.3:
                    want[i] = t
        elif k == 1:
            want = kept_lines(sorted(now.items()))
        elif k == 2:
            want = {d: now[d] for d, _, first in brute_components(sorted(now.items()), 5, 80) if d == first}
        elif k == 3:
            hits = {i: brute_hits(t, items) for i, t in now.items()}
            want = {i: t for i, t in now.items() if not (hits[i][1] and 20 * hits[i][1] >= hits[i][0])}
            texts = {r["doc_id"]: r["text"] for r in got}
            for i in [i for i in want if hits[i][1]]:  # passages are cut out, and nothing else
                assert brute_hits(texts[i], items)[:2] == (hits[i][0] - hits[i][1], 0)
                want[i] = texts[i]
            assert sum(h > 0 for _, h, _ in hits.values()) > len(now) - len(want) > 0
        if k < 4:
            assert {r["doc_id"]: r["text"] for r in got} == want and len(got) == len(want)
            assert all(own_values(r) == number[r["doc_id"]] for r in got)
            dropped.append(len(now) - len(want))
            now = want
        tables.append(got)
    assert min(dropped[:3]) > 0 and dropped[0] >= 20 and dropped[2] >= 6, dropped
    source, size = {i: s for i, _, s in rows}, {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in now.items()}
    order = sorted({source[i] for i in now if source[i] is not None}) + [None] * any(source[i] is None for i in now)
    total = {s: sum(size[i] for i in now if source[i] == s) for s in order}
    weight, lo, hi = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(2 * total[s], weight[s] * mid) for s in order) < 1.5 * sum(total.values()) else (lo, mid)
    for s in order:
        target = min(2 * total[s], weight[s] * lo)
        assert abs(sum(r["taken"] for r in tables[4] if r["source"] == s) - target) <= max(2, 0.01 * target)
    assert all(r["copies"] * r["size"] == r["taken"] > 0 and r["copies"] <= 2 and r["text"] == now[r["doc_id"]] for r in tables[4])
    again = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, tables[4]), key=str)


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{support.DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, support.DATA).count() == 0


def written(monkeypatch):
    """Gets the name and path of each scratch table from now on."""
    out, write = [], common.Scratch.write

    def noted(self, df, name):
        frame = write(self, df, name)
        out.append((name, frame._scratch_path.removeprefix("file://")))
        return frame

    monkeypatch.setattr(common.Scratch, "write", noted)
    return out


def test_components_are_labelled_only_after_new_links(spark, monkeypatch):
    """Each job leaves its plans and metrics in the driver's memory; scratch tables have no marker of success."""
    rng, tables = random.Random(30), written(monkeypatch)
    base = prose(rng, 90).split()
    alike = [" ".join([*base[:55], *(f"own{k}x{i}" for i in range(35))]) for k in range(40)]  # in buckets together, but no pair is linked
    rows = list(enumerate(alike + [prose(rng, 60) for _ in range(20)]))
    out = neardup.components(spark.createDataFrame(rows, "doc_id long, text string"), words=3, percent=80)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out.collect()) == brute_components(rows, 3, 80)
    names = [n for n, _ in tables]
    assert names.count("mixed") == 1 and not {"large", "small", "components2"} & set(names) and names.count("members") == 1
    assert not any("_SUCCESS" in os.listdir(path) for _, path in tables if os.path.isdir(path))


def test_links_of_later_turns_join_components(spark, monkeypatch):
    """Components that are grown turn by turn are those of all links at once."""
    rng, tables = random.Random(31), written(monkeypatch)
    rows = list(enumerate(t for _ in range(3) for t in near_texts(rng)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in neardup.components(frame, words=3, percent=85).collect())
    assert got == brute_components(rows, 3, 85)
    assert "large" in [n for n, _ in tables]


def test_the_sample_lies_in_a_file(spark, monkeypatch):
    """What training gathers isn't memory of the driver's own."""
    rng, seen = random.Random(32), []
    docs = spark.createDataFrame([(i, prose(rng, 30)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")

    def train(rows, **kw):
        for _, *arrays in rows:
            for x in arrays:
                while isinstance(x, np.ndarray):
                    x = x.base
                seen.append(x.obj if isinstance(x, memoryview) else x)

    monkeypatch.setattr(quality, "train", train)
    quality.fit(docs, labels)
    assert len(seen) > 20 and all(isinstance(x, mmap.mmap) for x in seen)
