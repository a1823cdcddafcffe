"""Registered queries over the driver's tables, with the same query in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tessera.functions import keys
from tessera.operators import layout, read, shards, trie, write

Query = Callable[[SparkSession, str], DataFrame]
_LONG = LongType()
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _le(k: str) -> str:
    """Eight little-endian bytes as hex, in DuckDB."""
    h = f"lpad(hex(({k})::ubigint), 16, '0')"
    return "(" + " || ".join(f"substr({h}, {15 - 2 * i}, 2)" for i in range(8)) + ")"


# -- reads


@_query("select * from orders where o_orderkey = 1234")
def query_point(spark, sf_dir):
    return read.query(_t(spark, sf_dir, "orders"), "o_orderkey", 1234)


@_query("select * from customer where c_name = (select c_name from customer where c_custkey = 7)")
def query_point_string(spark, sf_dir):
    customer = _t(spark, sf_dir, "customer")
    return customer.join(read.query(customer, "c_custkey", 7).select("c_name"), "c_name", "left_semi")


@_query("select * from orders where o_orderkey = 999999999")
def query_missing(spark, sf_dir):
    return read.query(_t(spark, sf_dir, "orders"), "o_orderkey", 999_999_999)


@_query(f"select * from orders where {_le('o_orderkey')} between {_le('1000')} and {_le('1003')}")
def range_number_le(spark, sf_dir):
    return read.range_scan(_t(spark, sf_dir, "orders"), "o_orderkey", 1000, 1003, "le")


@_query(f"select o_orderkey, (row_number() over (order by {_le('o_orderkey')}))::int pos from orders where {_le('o_orderkey')} between {_le('1000')} and {_le('1003')}")
def range_number_le_order(spark, sf_dir):
    """The rows' positions, so that the order itself is compared."""
    from pyspark.sql.window import Window

    df = _t(spark, sf_dir, "orders")
    by = read.ordering(df, "o_orderkey", "le")
    return df.where(read.between(df, "o_orderkey", 1000, 1003, "le")).select("o_orderkey", F.row_number().over(Window.orderBy(by)).alias("pos"))


@_query("select * from orders where o_orderkey between 1000 and 1100")
def range_number_be(spark, sf_dir):
    return read.range_scan(_t(spark, sf_dir, "orders"), "o_orderkey", 1000, 1100, "be")


@_query("select * from customer where c_name between 'Customer#000000100' and 'Customer#000000200'")
def range_string(spark, sf_dir):
    return read.range_scan(_t(spark, sf_dir, "customer"), "c_name", "Customer#000000100", "Customer#000000200")


@_query("select * from customer where c_name between 'z' and 'a'")
def range_inverted(spark, sf_dir):
    return read.range_scan(_t(spark, sf_dir, "customer"), "c_name", "z", "a")


LISTED = (7, 3, 99_999_999, 7, 1999, 0, 3, 42)


@_query(f"select (u.i - 1)::bigint pos, part.* from (select unnest({list(LISTED)}) k, unnest(range(1, {len(LISTED) + 1})) i) u join part on p_partkey = u.k")
def in_list_ordered(spark, sf_dir):
    return read.in_list(_t(spark, sf_dir, "part"), "p_partkey", LISTED, pos="pos")


@_query("select l.l_orderkey * 8 + l.l_linenumber as pos, o.* from lineitem l join orders o on o.o_orderkey = l.l_orderkey where l.l_quantity > 45")
def in_join(spark, sf_dir):
    """IN with a table of keys: repeats and misses included."""
    wanted = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("pos"))
    return read.in_join(_t(spark, sf_dir, "orders"), "o_orderkey", wanted, "l_orderkey", "pos")


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@_query(" union all ".join(f"select '{t}' as table_name, count(*) as records from {t}" for t in TABLES))
def count_records(spark, sf_dir):
    out = None
    for t in TABLES:
        n = read.count(_t(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "records")
        out = n if out is None else out.unionByName(n)
    return out


@_query("select * from supplier where s_name >= 'Supplier#000000050' order by s_name limit 1")
def lower_bound(spark, sf_dir):
    return read.lower_bound(_t(spark, sf_dir, "supplier"), "s_name", "Supplier#000000050")


@_query("select * from orders where o_orderkey >= 5000 order by o_orderkey limit 100")
def cursor_page(spark, sf_dir):
    return read.page(_t(spark, sf_dir, "orders"), "o_orderkey", 5000, 100, order="be")


@_query(f"select * from orders where {_le('o_orderkey')} > {_le('5000')} order by {_le('o_orderkey')} limit 50")
def cursor_next_le(spark, sf_dir):
    return read.page(_t(spark, sf_dir, "orders"), "o_orderkey", 5000, 50, after=True, order="le")


@_query("select * from customer where starts_with(c_name, 'Customer#0000001')")
def prefix_scan(spark, sf_dir):
    return read.prefix(_t(spark, sf_dir, "customer"), "c_name", "Customer#0000001")


@_query("select * from orders where o_orderkey between 100 and 5000 and o_totalprice > 100000 and o_orderstatus = 'F'")
def where_on_range(spark, sf_dir):
    df = _t(spark, sf_dir, "orders")
    return read.where(df.where(read.between(df, "o_orderkey", 100, 5000, "be")), "o_orderkey", "o_totalprice > 100000 and o_orderstatus = 'F'", "be")


@_query("select r.q, o.o_orderkey, o.o_custkey from (select c_custkey q, c_custkey * 10 lo, c_custkey * 10 + 99 hi from customer) r join orders o on o.o_orderkey between r.lo and r.hi")
def range_join_batch(spark, sf_dir):
    """A scan of 100 keys for every customer, as one join."""
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q"), (F.col("c_custkey") * 10).alias("lo"), (F.col("c_custkey") * 10 + 99).alias("hi"))
    return read.range_join(_t(spark, sf_dir, "orders"), "o_orderkey", c, "lo", "hi", 100).select("q", "o_orderkey", "o_custkey")


# -- mutations

def _new_rows(spark: SparkSession) -> DataFrame:
    return spark.sql("select * from values (0L, 'NEW', 3, 'NEWLAND', 1), (1L, 'NEW', 25, 'ATLANTIS', 2), (2L, 'NEW', 26, 'UTOPIA', 3), (3L, 'NEW', 25, 'AGAIN', 4), (4L, 'NEW', 7, 'OLD', 0) v(pos, op, n_nationkey, n_name, n_regionkey)")


@_query("select v.pos, v.k n_nationkey, case when n.n_nationkey is not null or exists (select 1 from (values (0, 3), (1, 25), (2, 26), (3, 25), (4, 7)) w(p, k) where w.k = v.k and w.p < v.pos) then 'DUPLICATE KEY' else 'OK' end outcome from (values (0::bigint, 3), (1, 25), (2, 26), (3, 25), (4, 7)) v(pos, k) left join nation n on n.n_nationkey = v.k")
def new_duplicate(spark, sf_dir):
    return write.outcomes(_t(spark, sf_dir, "nation").select("n_nationkey"), _new_rows(spark), "n_nationkey").select("pos", "n_nationkey", "outcome")


@_query("select * from nation union all select * from (values (25, 'ATLANTIS', 2), (26, 'UTOPIA', 3)) v")
def new_rows(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation")
    done = write.outcomes(nation.select("n_nationkey"), _new_rows(spark), "n_nationkey")
    return write.merge(nation, write.last_changes(done, "n_nationkey", nation.columns), "n_nationkey")


@_query("select * from region union all select k, min_by(n, pos) from (values (0, 2, 'X'), (1, 9, 'A'), (2, 9, 'B'), (3, 8, 'C')) v(pos, k, n) where k not in (select r_regionkey from region) group by k")
def bulk_dedupe(spark, sf_dir):
    region = _t(spark, sf_dir, "region")
    batch = spark.sql("select * from values (0L, 2, 'X'), (1L, 9, 'A'), (2L, 9, 'B'), (3L, 8, 'C') v(pos, r_regionkey, r_name)")
    return region.unionByName(write.bulk_new(region, batch, "r_regionkey", "pos"))


@_query("select c_custkey, c_name, c_nationkey, case when c_mktsegment = 'BUILDING' then 0.5 else c_acctbal end c_acctbal, case when c_mktsegment = 'BUILDING' then 'CHANGED' else c_mktsegment end c_mktsegment from customer")
def update_rows(spark, sf_dir):
    customer = _t(spark, sf_dir, "customer")
    changed = customer.where("c_mktsegment = 'BUILDING'").withColumns({"c_acctbal": F.lit(0.5), "c_mktsegment": F.lit("CHANGED")})
    missing = changed.withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    return write.update_rows(customer, "c_custkey", changed.unionByName(missing))


@_query("select * from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'F' and o_totalprice > 150000)")
def delete_rows(spark, sf_dir):
    gone = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F' and o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey"))
    return write.delete_rows(_t(spark, sf_dir, "customer"), "c_custkey", gone)


@_query("select c_custkey, c_name, c_nationkey, case when c_custkey in (select o_custkey from orders where o_totalprice < 100000) then c_acctbal + 1 else c_acctbal end c_acctbal, c_mktsegment from customer")
def rmw(spark, sf_dir):
    touched = _t(spark, sf_dir, "orders").where("o_totalprice < 100000").select(F.col("o_custkey").alias("c_custkey"))
    return write.modify(_t(spark, sf_dir, "customer"), "c_custkey", touched, "c_acctbal", F.col("c_acctbal") + 1)


_LOG = "select user_id pk, event_id + 1 lsn, case event_type when 'signup' then 'NEW' when 'error' then 'DELETE' else 'UPDATE' end op, event_id v from events where event_type <> 'view'"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("event_type") == "signup", "NEW").when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    return _t(spark, sf_dir, "events").where("event_type <> 'view'").select(F.col("user_id").alias("pk"), (F.col("event_id") + 1).alias("lsn"), op.alias("op"), F.col("event_id").alias("v"))


@_query(f"""with log as ({_LOG}),
d as (select *, coalesce(max(case when op = 'DELETE' then lsn end) over (partition by pk), 0) dl from log),
n as (select *, min(case when op = 'NEW' and lsn > dl then lsn end) over (partition by pk) nl from d)
select pk, max_by(v, lsn) v from n where lsn = nl or (op = 'UPDATE' and lsn > nl) group by pk""")
def log_fold(spark, sf_dir):
    return write.fold(_log(spark, sf_dir), "pk", "lsn", "op", F.col("v"))


@_query(f"""with log as ({_LOG}),
b as (select *, last_value(case op when 'NEW' then true when 'DELETE' then false end ignore nulls) over (partition by pk order by lsn rows between unbounded preceding and 1 preceding) there from log)
select pk, lsn, op, case when op = 'NEW' then case when coalesce(there, false) then 'DUPLICATE KEY' else 'OK' end else case when coalesce(there, false) then 'OK' else 'NOT FOUND' end end outcome from b""")
def log_outcomes(spark, sf_dir):
    """The reply to every command of the log, on a table that starts empty."""
    log = _log(spark, sf_dir)
    return write.outcomes(log.select("pk").limit(0), log, "pk", pos="lsn").select("pk", "lsn", "op", "outcome")


# -- shards

_SHARDS = [shards.Shard("a", 1, None, (2500).to_bytes(8, "big")), shards.Shard("b", 2, (2500).to_bytes(8, "big"), (9000).to_bytes(8, "big")), shards.Shard("c", 3, (9000).to_bytes(8, "big"), None)]
_SHARD_SQL = "(values (0, null, 2500), (1, 2500, 9000), (2, 9000, null)) s(shard, lo, hi)"


def _order_key() -> object:
    return keys.key_column(F.col("o_orderkey"), _LONG, "be")


@_query(f"select o_orderkey, shard from orders join {_SHARD_SQL} on (lo is null or o_orderkey >= lo) and (hi is null or o_orderkey < hi)")
def route_key(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", shards.shard_of(_order_key(), _SHARDS).alias("shard"))


@_query(f"select c_custkey q, shard from (select c_custkey, c_custkey * 10 a, c_custkey * 10 + 2000 b from customer) join {_SHARD_SQL} on (hi is null or a < hi) and (lo is null or b >= lo)")
def route_range(spark, sf_dir):
    be = lambda c: keys.key_column(c, _LONG, "be")
    q = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("q"), be(F.col("c_custkey") * 10).alias("a"), be(F.col("c_custkey") * 10 + 2000).alias("b"))
    return shards.route_ranges(q, _SHARDS, "a", "b").select("q", "shard")


@_query(f"select shard, count(*) n from orders join {_SHARD_SQL} on (lo is null or o_orderkey >= lo) and (hi is null or o_orderkey < hi) group by shard union all select -1, count(*) from orders")
def scatter_gather(spark, sf_dir):
    per = shards.scatter_gather(_t(spark, sf_dir, "orders"), _order_key(), _SHARDS)
    return per.unionByName(per.agg(F.lit(-1).alias("shard"), F.sum("n").alias("n")))


@_query(f"select shard, o_orderkey, o_totalprice from orders join {_SHARD_SQL} on (lo is null or o_orderkey >= lo) and (hi is null or o_orderkey < hi) where o_orderkey between 2400 and 2600")
def sharded_range(spark, sf_dir):
    """A RANGE over shards: only the shards it meets, one global key order."""
    df = _t(spark, sf_dir, "orders").withColumn("shard", shards.shard_of(_order_key(), _SHARDS))
    meets = shards.route_range(_SHARDS, (2400).to_bytes(8, "big"), (2600).to_bytes(8, "big"))
    return read.range_scan(df.where(F.col("shard").isin(meets)), "o_orderkey", 2400, 2600, "be").select("shard", "o_orderkey", "o_totalprice")


# -- layout and prefix tree


@_query("select sum(case when starts_with(n, c_name) then 0 else 1 end)::bigint chains from (select c_name, coalesce(lead(c_name) over (order by c_name), '') n from (select distinct c_name from customer))")
def chains_active(spark, sf_dir):
    return trie.chains_active(_t(spark, sf_dir, "customer").select(F.col("c_name").cast("binary").alias("k")), "k")


@_query("select sum(case when starts_with(n, w) then 0 else 1 end)::bigint chains from (select w, coalesce(lead(w) over (order by w), '') n from (select distinct unnest(string_split(text, ' ')) w from benchmark) where w <> '' and w = regexp_extract(w, '[ -~]+'))")
def chains_active_words(spark, sf_dir):
    """Words, of which some extend others."""
    words = _t(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("w")).where("w <> '' and w = regexp_extract(w, '[ -~]+', 0)")
    return trie.chains_active(words.select(F.col("w").cast("binary").alias("k")), "k")


_BITS = "(select s_name, list_reduce(list_transform(string_split(hex(encode(s_name)), ''), lambda c: lpad(bin(strpos('0123456789ABCDEF', c) - 1), 4, '0')), lambda a, b: a || b) bits from supplier)"
_PREFIXES = f"(select s_name, d, left(bits, d) prefix from (select s_name, bits, unnest(range(0, length(bits) + 1)) d from {_BITS}))"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "supplier").select(F.col("s_name").cast("binary").alias("k"))


@_query(f"select prefix, count(*) n, case when count(*) <= 1 then 0 else length(bin(count(*))) - 1 end::int weight from {_PREFIXES} group by prefix")
def subtree_weight(spark, sf_dir):
    return trie.subtree_weights(_names(spark, sf_dir), "k")


@_query(f"""with p as (select * from {_PREFIXES} where d > 0), n as (select prefix, count(*) n from p group by prefix),
l as (select a.prefix from n a join n b on b.prefix = left(a.prefix, length(a.prefix) - 1) || case when right(a.prefix, 1) = '1' then '0' else '1' end where b.n >= a.n)
select s_name as "key", count(l.prefix) + 1 crossings from p left join l using (prefix) group by s_name""")
def chain_crossings(spark, sf_dir):
    return trie.chain_crossings(_names(spark, sf_dir), "k").select(F.col("key").cast("string").alias("key"), "crossings")


@_query(f"select o_orderkey, ((row_number() over (order by {_le('o_orderkey')}) - 1) // 1000)::bigint block from orders")
def layout_lex(spark, sf_dir):
    df = _t(spark, sf_dir, "orders").select("o_orderkey")
    return layout.block_numbers(df, read.ordering(df, "o_orderkey", "le"), 1000)


# -- functions


@_query("select n_nationkey::varchar || ' | ' || n_name || ' | ' || n_regionkey::varchar as line from nation")
def row_render(spark, sf_dir):
    return _t(spark, sf_dir, "nation").select(keys.row_text(F.col("n_nationkey"), F.col("n_name"), F.col("n_regionkey")).alias("line"))


@_query(f"select o_orderkey, {_le('o_orderkey')} le, lpad(hex(o_orderkey::ubigint), 16, '0') be from orders")
def key_encode(spark, sf_dir):
    k = F.col("o_orderkey")
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.hex(keys.key_column(k, _LONG, "le")).alias("le"), F.hex(keys.key_column(k, _LONG, "be")).alias("be"))


@_query("select c_custkey, 'user' || lpad(c_custkey::varchar, 10, '0') as \"key\" from customer")
def make_key(spark, sf_dir):
    from tessera.functions.workload import make_key as make

    return _t(spark, sf_dir, "customer").select("c_custkey", make(F.col("c_custkey")).alias("key"))


@_query()
def crc32_log(spark, sf_dir):
    """The checksum that log records carry, of every text."""
    return _t(spark, sf_dir, "documents").select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))


@_query("select o_custkey, count(*) n, sum(cast(round(o_totalprice * 100) as bigint))::bigint cents from orders where o_orderkey in (select l_orderkey from lineitem where l_quantity > 45) group by o_custkey")
def keyed_rollup(spark, sf_dir):
    """SQL beside the command language: attached tables are ordinary frames."""
    big = _t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return _t(spark, sf_dir, "orders").join(big, "o_orderkey", "left_semi").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.round(F.col("o_totalprice") * 100).cast("bigint")).alias("cents"))
