"""URL filters by a temporal list join. DataFrame functions only.

A list has dated entries: (kind, pattern, listed, action), where kind is "url", "host" or "domain" (a host
and all hosts below it) and action "add" or "remove". Of a pattern's entries on one day the last action
in the order add, remove holds. Entries become validity intervals [from, until): runs of "add" until the
next "remove". Every capture is then held against the intervals of its URL, its host and its host's parent
domains that are active when it was fetched.

Intervals are first gathered for each distinct host and URL, where they are few: at most one for two
changes of a pattern on the list. Captures join that on host and on URL and pick the active one, so a
capture is never multiplied. A capture whose host and URL no entry can mean (a bit set of the listed ones tells) takes
no part in the joins; of a host or URL that is listed, captures are dealt out in ``SHARES`` shares, so that one with a
third of all captures is not a single task's; the listed ones are never broadcast, as their number has no bound.

Defined results: a null or malformed URL has no host and matches by URL only; a null fetch time matches
nothing; entries with a null field are ignored; repeated entries count once; repeated captures are judged one
by one; with an empty list nothing is blocked. Of several active entries the most special counts: url,
host, then the longest domain. Columns of captures are passed on; ones named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import Scratch, apart, own_names, without

RESULTS = ("blocked", "rule", "pattern", "listed_from")
SHARES = 16


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and final dot, an IPv6 address in its brackets; null if there is none."""
    h = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#\[]+)", 1)
    return F.nullif(F.regexp_replace(h, r"\.$", ""), F.lit(""))


def url_key(url: Column) -> Column:
    """The URL without fragment, with scheme and host (and user) in lower case."""
    bare = F.regexp_replace(url, r"#.*$", "")
    start = F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    return F.concat(F.lower(start), F.substring(bare, F.length(start) + 1, F.length(bare)))


def intervals(entries: DataFrame) -> DataFrame:
    """(kind, pattern, since, until): until is null while the entry holds."""
    e = entries.select(F.lower("kind").alias("kind"), F.when(F.lower("kind") == "url", url_key(F.col("pattern"))).otherwise(F.lower("pattern")).alias("pattern"), F.to_date("listed").alias("listed"), F.lower("action").alias("action")).dropna()
    daily = e.groupBy("kind", "pattern", "listed").agg(F.max("action").alias("action"))  # "remove" sorts last; a day's entries become one before they are dealt by pattern
    over = W.partitionBy("kind", "pattern").orderBy("listed")
    changes = daily.withColumn("_was", F.lag("action").over(over)).where(F.col("_was").isNull() | (F.col("_was") != F.col("action")))
    return changes.withColumn("until", F.lead("listed").over(over)).where(F.col("action") == "add").select("kind", "pattern", F.col("listed").alias("since"), "until")


def _gathered(keys: DataFrame, held: DataFrame, on: list[str], by: str) -> DataFrame:
    """An array of intervals for each distinct key that has any, most special first."""
    found = keys.join(held, on).select(F.col(by), F.struct(F.col("_order").alias("order"), "since", "until", F.col("kind").alias("rule"), "pattern").alias("x"))
    return found.groupBy(by).agg(F.array_sort(F.collect_set("x")).alias("_held"))


def filter_urls(captures: DataFrame, entries: DataFrame, *, url_col: str = "url", fetched_col: str = "fetched") -> DataFrame:
    """``captures`` with blocked, and of the most special active entry its rule, pattern and first day."""
    own, back, names = own_names(without(captures, *RESULTS))
    held = intervals(entries)
    c = own.withColumns({"_host": host_of(F.col(names[url_col])), "_url": url_key(F.col(names[url_col])), "_day": F.to_date(F.col(names[fetched_col]))})
    hosts = c.select("_host").where(F.col("_host").isNotNull()).distinct()
    labels = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"), i.alias("_order")))
    own = F.array(F.struct(F.lit("host").alias("kind"), F.col("_host").alias("pattern"), F.lit(0).alias("_order")))
    host_keys = hosts.select("_host", F.inline(F.concat(own, suffixes)))
    by_host = _gathered(host_keys, held, ["kind", "pattern"], "_host").withColumnsRenamed({"_host": "_h", "_held": "_by_host"})
    url_keys = held.where(F.col("kind") == "url").select(F.col("pattern").alias("_url"), "kind", "pattern", "since", "until", F.lit(-1).alias("_order"))
    by_url = url_keys.select(F.col("_url").alias("_u"), F.struct(F.col("_order").alias("order"), "since", "until", F.col("kind").alias("rule"), "pattern").alias("x")).groupBy("_u").agg(F.array_sort(F.collect_set("x")).alias("_by_url"))
    scratch = Scratch(captures.sparkSession, "urls")
    j = c
    for key, table, on in (("_host", by_host, "_h"), ("_url", by_url, "_u")):
        table = scratch.write(table, "listed")
        maybe, clear = apart(j, F.col(key), table, F.col(on))
        shared = table.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
        dealt = maybe.withColumn("_s", F.pmod(F.xxhash64(*names.values()), F.lit(SHARES)))
        j = dealt.join(shared.hint("merge"), (F.col(key) == F.col(on)) & (F.col("_s") == F.col("_share")), "left").drop("_s", "_share", on).unionByName(clear, allowMissingColumns=True)
    nothing = F.array().cast("array<struct<order:int,since:date,until:date,rule:string,pattern:string>>")
    every = F.concat(F.coalesce("_by_url", nothing), F.coalesce("_by_host", nothing))
    active = F.filter(every, lambda x: (x["since"] <= F.col("_day")) & (x["until"].isNull() | (F.col("_day") < x["until"])))
    j = j.withColumn("_x", F.get(active, F.lit(0)))
    return j.select(*back, F.col("_x").isNotNull().alias("blocked"), F.col("_x")["rule"].alias("rule"), F.col("_x")["pattern"].alias("pattern"), F.col("_x")["since"].alias("listed_from"))
