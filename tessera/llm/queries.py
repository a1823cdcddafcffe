"""The queries of this subpackage, and DuckDB SQL where it can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, hamming, html_text, linededup, mixing, neardup, quality, tokens, url_filter, warc
from tessera.llm.common import table


def op1_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest sign codes of every vector whose id is divisible by 100, among all."""
    codes = table(spark, sf_dir, "embeddings").select("vec_id", hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(codes, codes.where(F.col("vec_id") % 100 == 0), k=10)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").cast("long").alias("n_lines"), F.col("_n_gone").cast("long").alias("n_dropped"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    found = decontaminate.find_contamination(docs, bench, with_spans=False)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.is_contaminated().alias("contaminated"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.components(table(spark, sf_dir, "documents"), words=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as captures against a list of hosts, domains and URLs made from the pages themselves: the
    tables have neither a list nor dates, so both come from ids and digests, alike in Spark and in SQL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n.cast("int"))
    captures = pages.withColumn("fetched", day(F.pmod("page_id", F.lit(365))))
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("h")).where("h is not null").distinct()
    domains = hosts.select(F.substring_index("h", ".", -2).alias("h")).distinct()
    names = hosts.select(F.lit("host").alias("kind"), F.col("h").alias("pattern")).unionByName(domains.select(F.lit("domain").alias("kind"), F.col("h").alias("pattern")))
    digit = lambda i: F.conv(F.substring(F.md5(F.col("pattern").cast("binary")), i, 1), 16, 10).cast("int")
    changes = F.array(*[F.struct(day(digit(2) * 10 + shift).alias("listed"), F.lit(action).alias("action")) for shift, action in ((0, "add"), (45, "remove"), (120, "add"), (120, "add"), (200, "remove"), (200, "add"))])
    named = names.where(digit(1) < 5).select("kind", "pattern", F.inline(changes))
    urls = pages.where("page_id % 17 = 0").select(F.lit("url").alias("kind"), F.col("url").alias("pattern"), day(F.pmod("page_id", F.lit(300))).alias("listed"), F.lit("add").alias("action"))
    return url_filter.filter_urls(captures, named.unionByName(urls)).select("page_id", "fetched", "blocked", "rule", "pattern", "listed_from")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {q.__name__: q for q in (op1_hamming_topk, op2_line_dedup, op3_decontamination, op4_mixing, op5_token_counts, op6_minhash, op7_quality, op8_url_filter, op9_html_text, op10_warc)}

_WORDS3 = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_HOST = "nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.\\-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#]*\\]|[^/:?#\\[]+)', 1), '\\.$', ''), '')"
_START = "regexp_extract(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*')"
_URL = f"lower({_START}) || substr(regexp_replace(url, '#.*$', ''), length({_START}) + 1)"
_CHANGES = "(values (0, 'add'), (45, 'remove'), (120, 'add'), (200, 'add'), (200, 'remove')) c(shift, action)"
_DIGIT = "(strpos('0123456789abcdef', substr(md5(pattern), {}, 1)) - 1)::int"

ORACLE_SQL = {
    "op1_hamming_topk": """
with c as (select vec_id, list_transform(embedding, lambda x: coalesce(x > 0, false)) b from embeddings where embedding is not null),
d as (select q.vec_id query_id, r.vec_id neighbour_id, len(list_filter(list_zip(q.b, r.b), lambda z: z[1] <> z[2]))::int distance
      from c q, c r where q.vec_id % 100 = 0 and q.vec_id <> r.vec_id),
k as (select *, row_number() over (partition by query_id order by distance, neighbour_id)::int "rank" from d)
select query_id, "rank", neighbour_id, distance from k where "rank" <= 10""",
    "op2_line_dedup": """
with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) no from documents),
u as (select line, length(line) n, min((doc_id, no)) place from l where trim(line) <> '' group by line),
near as (select distinct b.line from u a join u b on b.n between a.n - 1 and a.n + 1 and a.place < b.place
         where a.n >= 20 and b.n >= 20 and (left(a.line, a.n // 2 - 1) = left(b.line, a.n // 2 - 1) or right(a.line, a.n // 2 - 1) = right(b.line, a.n // 2 - 1)) and levenshtein(a.line, b.line) <= 1),
k as (select l.*, trim(l.line) = '' or (u.place = (l.doc_id, l.no) and near.line is null) kept from l left join u using (line) left join near using (line))
select doc_id, count(*)::bigint n_lines, count(*) filter (where not kept)::bigint n_dropped, md5(coalesce(string_agg(line, chr(10) order by no) filter (where kept), '')) kept_md5
from k group by doc_id""",
    "op8_url_filter": f"""
with p as (select page_id, url, {_URL} u, {_HOST} h, date '2024-01-01' + (page_id % 365)::int fetched from pages),
names as (select distinct 'host' kind, h pattern from p where h is not null union
          select distinct 'domain', array_to_string(list_slice(string_split(h, '.'), -2, -1), '.') from p where h is not null),
entries as (
  select kind, pattern, date '2024-01-01' + ({_DIGIT.format(2)} * 10 + shift)::int listed, action from names, {_CHANGES} where {_DIGIT.format(1)} < 5
  union all select 'url', u, date '2024-01-01' + (page_id % 300)::int, 'add' from p where page_id % 17 = 0),
daily as (select kind, pattern, listed, max(action) action from entries group by all),
spans as (select kind, pattern, action, listed since, lead(listed) over (partition by kind, pattern order by listed) until from daily),
runs as (select *, sum(case when was is distinct from action then 1 else 0 end) over (partition by kind, pattern order by since) run
         from (select *, lag(action) over (partition by kind, pattern order by since) was from spans)),
held as (select kind, pattern, min(since) since, case when bool_or(until is null) then null else max(until) end until
         from runs where action = 'add' group by kind, pattern, run),
hit as (
  select p.page_id, kind as rule, pattern, since, row_number() over (partition by p.page_id order by case kind when 'url' then 0 when 'host' then 1 else 2 end, length(pattern) desc) k
  from p join held on (kind = 'url' and pattern = u or kind = 'host' and pattern = h or kind = 'domain' and (h = pattern or ends_with(h, '.' || pattern)))
  and since <= fetched and (until is null or fetched < until))
select p.page_id, p.fetched, rule is not null blocked, rule, pattern, since listed_from from p left join hit on p.page_id = hit.page_id and k = 1""",
    "op10_warc": """
with p as (select page_id, coalesce(html, '') h from pages),
f as (select page_id, octet_length(encode(h)) n, sha1(h) x, min(page_id) over (partition by h) first from p),
b as (select *, array_to_string(list_transform(string_split(x, ''), lambda c: lpad(bin(strpos('0123456789abcdef', c) - 1), 4, '0')), '') bits from f)
select page_id, n::bigint payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_reduce(list_transform(string_split(substr(bits, 1 + 5 * i, 5), ''), lambda c: c::int), lambda a, c: 2 * a + c)::int, 1)), '') payload_digest,
       case when page_id = first then 'response' else 'revisit' end record_type, case when page_id <> first then first end refers_to
from b""",
    "op3_decontamination": f"""
with item as (select coalesce(item_id::varchar, '') id, {_WORDS3} w from benchmark),
win as (
  select distinct id, n, array_to_string(w[i : i + n - 1], ' ') win
  from (select id, w, least(len(w), 13) n, unnest(range(1, len(w) - least(len(w), 13) + 2)) i from item where len(w) > 0)
),
doc as (select doc_id, row_number() over () rid, {_WORDS3} w from documents),
lens as (select distinct n from win),
spot as (
  select rid, n, i, array_to_string(w[i : i + n - 1], ' ') win
  from (select rid, w, n, unnest(range(1, len(w) - n + 2)) i from doc, lens where len(w) >= n)
),
hit as (select distinct spot.rid, spot.i, spot.n, win.id from spot join win on spot.n = win.n and spot.win = win.win),
words as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + n)) p from hit) group by rid),
ids as (select rid, count(*) n_items, string_agg(id, ',' order by id) ids from (select distinct rid, id from hit) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
       sha256(coalesce(ids, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from doc left join words using (rid) left join ids using (rid)""",
}
