"""Shards, prefix-tree analytics, layout, workloads and the front ends."""

import io
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import server
from tessera.client import Client
from tessera.engine import Engine
from tessera.functions import workload
from tessera.operators import layout, read, shards, trie, write
from tessera.repl import loop


def test_shards():
    s = shards.parse_config("h1 1 - 0000000080000000\n\nh2 2 0000000080000000 -\n")
    edge = bytes.fromhex("0000000080000000")
    assert shards.route_key(s, b"") == 0 and shards.route_key(s, edge) == 1 and shards.route_key(s, b"\xff" * 9) == 1
    assert shards.route_range(s, b"\x00", edge) == [0, 1] and shards.route_range(s, edge, edge) == [1] and shards.route_range(s, edge, b"") == []


def test_rows_of_shards_add_up(spark):
    s = shards.parse_config("a 1 - 0000000000000064\nb 2 0000000000000064 00000000000000c8")
    from tessera.functions.keys import key_column
    from pyspark.sql.types import LongType

    got = {r["shard"]: r["n"] for r in shards.scatter_gather(spark.range(1000), key_column(F.col("id"), LongType(), "be"), s).collect()}
    assert got == {0: 100, 1: 100, None: 800}
    frame = shards.shard_frame(spark, s).collect()
    assert [bytes(r["hi"])[-1] for r in frame] == [0x64, 0xC8] and frame[0]["lo"] is None


def brute_chains(keys):
    return sum(not any(o != k and o.startswith(k) for o in keys) for k in set(keys))


def brute_crossings(keys):
    bits = {k: "".join(f"{b:08b}" for b in k) for k in keys}
    size = Counter(b[:d] for b in bits.values() for d in range(1, len(b) + 1))
    flip = lambda p: p[:-1] + ("0" if p[-1] == "1" else "1")
    return {k: 1 + sum(size[flip(b[:d])] >= size[b[:d]] for d in range(1, len(b) + 1)) for k, b in bits.items()}


@pytest.mark.parametrize("seed", [7, 42])
def test_prefix_tree(spark, seed):
    rng = random.Random(seed)
    keys = {rng.randbytes(rng.randint(1, 3)) for _ in range(120)} | {b"ab", b"abc", b"a", b"abcd", b"\x80", b"\x80\x00"}
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary")
    assert trie.chains_active(df, "k").first()["chains"] == brute_chains(keys)
    assert {bytes(r["key"]): r["crossings"] for r in trie.chain_crossings(df, "k").collect()} == brute_crossings(keys)


def test_crossings_stay_logarithmic(spark):
    rng = random.Random(42)
    keys = {rng.randbytes(8) for _ in range(512)}
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary")
    assert trie.chain_crossings(df, "k").agg(F.max("crossings")).first()[0] <= 2 * 9
    assert trie.chains_active(df.limit(0), "k").first()["chains"] == 0


def test_layout_keeps_rows(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"))
    parts = layout.sorted_by_key(df, "k", 5000, 1000).withColumn("p", F.spark_partition_id()).collect()
    assert len({r["p"] for r in parts}) == 5 and sorted(r["k"] for r in parts) == list(range(5000))
    got = layout.block_numbers(df, F.col("k"), 300).collect()
    assert all(r["block"] == r["k"] // 300 for r in got) and len(got) == 5000


def test_pages_visit_every_key_once(spark):
    df = spark.createDataFrame([(k,) for k in range(0, 600, 7)], "k long")
    seen, last = [], None
    while rows := read.page(df, "k", last, 40, after=last is not None).collect():
        seen += [r["k"] for r in rows]
        last = seen[-1]
    assert seen == sorted(range(0, 600, 7), key=lambda k: k.to_bytes(8, "little"))


def test_fold_equals_a_state_machine(spark):
    rng, state, log = random.Random(3), {}, []
    for lsn in range(1, 600):
        k, op = rng.randrange(25), rng.choice(("NEW", "UPDATE", "UPDATE", "DELETE"))
        log.append((k, lsn, op, lsn))
        if op == "DELETE":
            state.pop(k, None)
        elif (op == "NEW") != (k in state):
            state[k] = lsn
    df = spark.createDataFrame(log, "pk long, lsn long, op string, v long")
    assert {r["pk"]: r["v"] for r in write.fold(df, "pk", "lsn", "op", F.col("v")).collect()} == state


def test_workloads(spark):
    req = workload.requests(spark, "E", 2000, 1000).collect()
    ops = Counter(r["op"] for r in req)
    assert set(ops) == {"scan", "insert"} and 0.92 < ops["scan"] / 2000 < 0.98
    assert all(0 <= r["id"] < 1000 for r in req if r["op"] == "scan") and all(1 <= r["length"] <= 100 for r in req)
    ranks = Counter(r[0] for r in spark.range(20_000).select(F.rand(1).alias("u")).select(workload.zipf_rank(F.col("u"), 1000)).collect())
    assert ranks.most_common(1)[0][0] == 0 and max(ranks) <= 999 and ranks[0] > 5 * ranks[20]
    first = workload.records(spark, 3).collect()
    assert first[2]["key"] == "user0000000002" and all(len(v) == 100 for v in first[0][1:]) and len(set(first[0])) == 11
    assert workload.scrambled([0, 1], 1000) == [workload.scramble(0, 1000), workload.scramble(1, 1000)]


def test_front_ends(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    out = io.StringIO()
    loop(e, ["TABLE t(id number PRIMARY KEY)\n", "\n", "NEW(t, 1)\n", "nope\n", "exit\n", "NEW(t, 2)\n"], out)
    assert out.getvalue().splitlines() == ["OK", "OK", "ERROR: expected command keyword"]
    with server.Server(("127.0.0.1", 0), e, threads=2) as s:
        thread = threading.Thread(target=s.serve_forever, daemon=True)
        thread.start()
        a = Client("127.0.0.1", s.server_address[1])
        assert a.exec("QUERY(t, 1)") == "1" and a.exec("QUERY(t, 2)") == "NOT FOUND" and a.exec("QUERY(u, 1)") == "ERROR: unknown table: u"
        assert a.exec("HELP").startswith("TABLE name") and a.exec("quit") == "BYE"
        a.close()
        s.shutdown()


def test_idle_compaction(spark, tmp_path):
    e = Engine(spark, f"file://{tmp_path}/db")
    e.exec("TABLE t(id number PRIMARY KEY)")
    e.exec("BULK t (1) (2)")
    stop = threading.Event()
    thread = server.compact_when_idle(e, idle=0.2, rest=60, stop=stop)
    for _ in range(200):
        if e.catalog.tables["t"].manifest.base:
            break
        stop.wait(0.1)
    stop.set()
    thread.join(10)
    assert e.catalog.tables["t"].manifest.base and not e.catalog.tables["t"].manifest.deltas and e.exec("COUNT(t)") == "2 records"


def test_two_servers_answer_as_one(spark, tmp_path):
    """Keys before "m" belong to the first; every command can be sent to either."""
    from tessera.cluster import Router
    from tessera.operators.shards import Shard

    engines = [Engine(spark, f"file://{tmp_path}/s{i}") for i in range(2)]
    servers = [server.Server(("127.0.0.1", 0), e, threads=4) for e in engines]
    split = b"m"
    shards = [Shard("127.0.0.1", servers[0].server_address[1], None, split), Shard("127.0.0.1", servers[1].server_address[1], split, None)]
    for i, s in enumerate(servers):
        s.target = Router(engines[i], shards, i)
        threading.Thread(target=s.serve_forever, daemon=True).start()
    a, b = (Client("127.0.0.1", s.server_address[1]) for s in servers)
    try:
        assert a.exec("TABLE t(k string PRIMARY KEY, v number)") == "OK"
        assert b.exec("BULK t ('alpha', 1) ('zeta', 2) ('mid', 3) ('beta', 4)") == "4 inserted"
        assert a.exec("NEW(t, 'omega', 5)") == "OK" and b.exec("NEW(t, 'omega', 6)") == "DUPLICATE KEY"
        assert b.exec("UPDATE(t, 'beta', 7)") == "OK" and a.exec("QUERY(t, 'beta')") == "beta | 7"
        assert a.exec("RANGE(t, 'a', 'zz')") == b.exec("RANGE(t, 'a', 'zz')") == "\n".join(["alpha | 1", "beta | 7", "mid | 3", "omega | 5", "zeta | 2", "(5 rows)"])
        assert a.exec("IN(t, 'zeta', 'none', 'alpha', 'zeta')") == "zeta | 2\nalpha | 1\nzeta | 2\n(3 rows)"
        assert a.exec("COUNT(t)") == b.exec("COUNT(t)") == "5 records" and b.exec("DELETE(t, 'alpha')") == "OK"
        assert [e.exec("COUNT(t)") for e in engines] == ["1 records", "3 records"]
        assert a.exec("RANGE(t, 'x', 'b')") == "NOT FOUND" and a.exec("NEW(t, '" + "w" * 65 + "', 1)").startswith("ERROR: value too long")
    finally:
        a.close()
        b.close()
        for s in servers:
            s.shutdown()
            s.server_close()
