"""Line dedup by a deletion-neighbourhood join. DataFrame functions only.

Lines of all documents are put in order by (id, hash of the document's text, line number). A line goes if an
equal line comes before it, or, from ``min_chars`` characters on, if the first occurrence of some other
line within ``edit_bound`` (0 or 1) edits comes before its own first occurrence. Lines without a character but
spaces stay; a tab is a character.

Exact repeats are groups by a 128-bit hash with the smallest place kept, aggregated before the shuffle. For one edit:

1. A line is cut into ``PARTS`` parts of about equal length. Two lines within one edit agree in all but one part, so
   each line has a hashed key for the rest around each of its parts, at lengths rounded down to ``STEP`` bytes; near
   the rounding's border it has those of the length below, too. Lines whose keys nobody shares can have no partner.
   What the others leave out at a shared key is a short line under that key, and is narrowed down once more alike.
2. For each shared key, those that remain emit variants of the part left out: a hashed key for each way to delete one of its
   characters, and keys for the whole part, all under the shared key. A long part does this block by block of
   ``BLOCK`` characters, the rest of it hashed once. Variants that only one line has are dropped after aggregation.
3. Lines that share a variant with the same deleted place differ in that character only; a line whose own part
   equals a deletion of another's is that one less a character. In either group each line is paired with the
   earliest only, never with all, and the pair is verified by edit distance.

Defined results: a null text stays null, and a text without lines stays as it is; a null id comes first; rows
that repeat with equal text are one occurrence and all keep their lines; a document that loses all its lines
gets the text ""; an empty table gives none. Other columns are passed on untouched, whatever their names, but for
ones named like the two counts, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tessera.llm.common import Scratch, apart, maybe_in, own_names, without

PARTS, STEP, BLOCK = 4, 8, 256
#: Bytes of the longest character.
WIDEST = 4
#: A line's name: two hashes of 64 bits.
NAME = ["d", "d2"]


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, no, line): every line that isn't blank; row tells apart texts with the same id."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), F.posexplode(F.split(text, "\n")).alias("no", "line")).where(F.trim("line") != "")


def _named(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"d": F.xxhash64("line"), "d2": F.xxhash64(F.lit(1), "line")})


def _bounds(size: Column, i: Column) -> tuple[Column, Column]:
    """Bytes before and after part ``i`` of a length ``size``; a character that begins in the part is left out whole."""
    after = size - F.floor(size * (i + 1) / F.lit(float(PARTS))).cast("int") - (WIDEST - 1)
    return F.floor(size * i / F.lit(float(PARTS))).cast("int"), F.greatest(after, F.lit(0))


def _sizes(line: Column) -> tuple[Column, Column, Column]:
    """The rounded length in bytes, whether a partner can have the one below, and that."""
    n = F.octet_length(line)
    size = n - F.pmod(n, F.lit(STEP))
    # a partner with fewer bytes lacks an ASCII character, or a wider one stands for a narrower
    border = F.pmod(n, F.lit(STEP)) < F.when(n == F.length(line), 1).otherwise(WIDEST)
    return size, border & (size > 0), size - STEP


def _part_keys(line: Column) -> Column:
    """Hashes of what is around each part: PARTS of them, or twice as many."""
    raw, n = line.cast("binary"), F.octet_length(line)

    def keys(size: Column) -> list[Column]:
        out = []
        for i in range(PARTS):
            before, after = _bounds(size, F.lit(i))
            out.append(F.xxhash64(F.lit(i), size, F.substring(raw, F.lit(1), before), F.substring(raw, n - after + 1, after)))
        return out

    size, border, below = _sizes(line)
    return F.when(border, F.array(*keys(size), *keys(below))).otherwise(F.array(*keys(size)))


def _parts(found: DataFrame) -> DataFrame:
    """(k, d, d2, start, part): of a line (k, d, d2, pos, start, line) and the number ``pos`` of its key the part left out,
    in whole characters; start is the line's own place, and then the part's."""
    line, n = F.col("line"), F.octet_length("line")
    size, _, below = _sizes(line)
    before, after = _bounds(F.when(F.col("pos") < PARTS, size).otherwise(below), F.pmod("pos", F.lit(PARTS)))
    raw = line.cast("binary")
    chars = lambda upto: F.length(F.substring(raw, F.lit(1), upto).cast("string"))  # noqa: E731  one that is cut counts
    cut = found.select("k", *NAME, "line", F.col("start").alias("_from"), before.alias("_before"), chars(before).alias("_c"), chars(n - after).alias("_e"))
    start = F.col("_c") - (F.octet_length(F.substring("line", F.lit(1), F.col("_c"))) > F.col("_before")).cast("int")
    return cut.withColumn("_s", start).select("k", *NAME, (F.col("_from") + F.col("_s")).alias("start"), F.substring("line", F.col("_s") + 1, F.col("_e") - F.col("_s")).alias("part"))


def _variants(parts: DataFrame) -> DataFrame:
    """(v, at, d, d2): a row for each deletion (at: the deleted place from 1) and for the part itself (at 0)."""
    part, n = F.col("part"), F.length("part")
    block = F.col("b") * BLOCK
    cut = parts.where(n > 0).withColumn("b", F.explode(F.sequence(F.lit(0), F.floor((n - 1) / F.lit(float(BLOCK))).cast("int"))))
    cut = cut.select("k", *NAME, "start", "b", F.xxhash64(F.substring(part, F.lit(1), block)).alias("pre"), F.substring(part, block + 1, F.lit(BLOCK)).alias("blk"), F.xxhash64(F.substring(part, block + BLOCK + 1, n)).alias("suf"))
    size = F.length("blk")
    cut = cut.withColumn("q", F.explode(F.sequence(F.lit(1), size)))
    less = F.concat(F.substring("blk", F.lit(1), F.col("q") - 1), F.substring("blk", F.col("q") + 1, size))
    deleted = cut.select(F.xxhash64("k", "b", "pre", "suf", less).alias("v"), (F.col("start") + block + F.col("q")).alias("at"), *NAME)
    whole = parts.withColumn("b", F.explode(F.sequence(F.lit(0), F.floor(n / F.lit(float(BLOCK))).cast("int"))))
    short = F.substring(part, block + 1, F.lit(BLOCK - 1))
    itself = whole.select(F.xxhash64("k", "b", F.xxhash64(F.substring(part, F.lit(1), block)), F.xxhash64(F.substring(part, block + BLOCK, n)), short).alias("v"), F.lit(0).alias("at"), *NAME)
    return deleted.unionByName(itself)


def _shared(df: DataFrame, key: str) -> DataFrame:
    """Values of ``key`` that two different lines have."""
    return df.groupBy(key).agg(F.min("d").alias("_a"), F.max("d").alias("_b")).where(F.col("_a") != F.col("_b")).select(key)


def _near(docs: DataFrame, distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """(d, d2, place) of the distinct lines that have an earlier one within an edit. ``docs``: (id, text)."""
    keyed = distinct.where(F.col("keys").isNotNull()).select(*NAME, "place", F.posexplode("keys").alias("pos", "k"))
    common = scratch.write(_shared(keyed, "k"), "common")
    found = scratch.write(maybe_in(keyed, F.col("k"), common, F.col("k")).join(common, "k"), "found")
    spot = F.xxhash64("id", "row", "no")
    some = scratch.write(found.select(*NAME, "place").distinct().withColumn("w", F.xxhash64("place.id", "place.row", "place.no")), "some")
    lines = _occurrences(maybe_in(docs, F.col("id"), some, F.col("place")["id"]), "id", "text").withColumn("w", spot)
    met = maybe_in(lines, F.col("w"), some, F.col("w")).join(some, "w").where(F.struct("id", "row", "no") == F.col("place"))
    texts = scratch.write(met.select(*NAME, "place", "line").dropDuplicates(NAME), "texts")
    parts = scratch.write(_parts(found.select("k", "pos", *NAME, F.lit(0).alias("start")).join(texts.select(*NAME, "line"), NAME)), "parts")
    narrow = parts.select(F.col("k").alias("_k"), *NAME, "start", F.col("part").alias("line"), F.posexplode(_part_keys(F.col("part"))).alias("pos", "_p")).withColumn("k", F.xxhash64("_k", "_p"))
    again = scratch.write(_shared(narrow, "k"), "again")
    variants = scratch.write(_variants(_parts(maybe_in(narrow, F.col("k"), again, F.col("k")).join(again, "k"))), "variants")
    shared = scratch.write(_shared(variants, "v"), "shared")
    met = maybe_in(variants, F.col("v"), shared, F.col("v")).join(shared, "v").join(texts.select(*NAME, "place"), NAME)
    met = scratch.write(met, "met")
    low, of = F.col("low"), W.partitionBy("v")  # a variant has few deleted places, however many lines have it
    lows = met.groupBy("v", "at").agg(F.min(F.struct("place", *NAME)).alias("low"))
    lows = lows.withColumn("_itself", F.min(F.when(F.col("at") == 0, low)).over(of)).withColumn("_deleted", F.min(F.when(F.col("at") > 0, low)).over(of))
    lows = lows.select("v", "at", F.when(F.col("at") > 0, F.array(low, "_itself")).otherwise(F.array("_deleted")).alias("lows"))
    pairs = met.join(lows, ["v", "at"]).select(*NAME, "place", F.explode("lows").alias("low")).where(low["place"] < F.col("place")).select(*NAME, low["d"].alias("e"), low["d2"].alias("e2")).distinct()
    a, b = texts.select(*NAME, "place", F.col("line").alias("_a")), texts.select(F.col("d").alias("e"), F.col("d2").alias("e2"), F.col("line").alias("_b"))
    near = pairs.join(a, NAME).join(b, ["e", "e2"]).where(F.levenshtein("_a", "_b", 1) >= 0).select(*NAME, "place").distinct()
    near = scratch.write(near, "near")
    scratch.drop(common, found, some, texts, parts, again, variants, shared, met)
    return near


def dropped_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edit_bound: int = 1, min_chars: int = 20) -> DataFrame:
    """(id, row, gone): the numbers of the lines, from 0, that each document loses; documents that lose none are left out."""
    if edit_bound not in (0, 1):
        raise ValueError("edit_bound is 0 or 1")
    scratch = Scratch(docs.sparkSession, "lines")
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    occ = _named(_occurrences(docs, "id", "text"))
    place = F.struct("id", "row", "no")
    keys = F.when(F.length("line") >= min_chars, _part_keys(F.col("line"))) if edit_bound else F.lit(None).cast("array<bigint>")
    distinct = scratch.write(occ.withColumn("keys", keys).groupBy(*NAME).agg(F.min(place).alias("place"), F.count("*").alias("n"), F.first("keys").alias("keys")), "distinct")
    going = distinct.where(F.col("n") > 1).select(*NAME, "place", F.lit(False).alias("near"))
    if edit_bound:
        going = going.unionByName(_near(docs, distinct, scratch).withColumn("near", F.lit(True)))
        going = going.groupBy(*NAME).agg(F.min("place").alias("place"), F.max("near").alias("near"))
    going = scratch.write(going, "going")  # only lines of which some occurrence goes
    scratch.drop(distinct)
    lost = maybe_in(occ.drop("line"), F.col("d"), going, F.col("d")).join(going, NAME).where(F.col("near") | ~F.col("place").eqNullSafe(place))
    return lost.groupBy("id", "row").agg(F.collect_set("no").alias("gone"))


def _mask(gone: Column) -> Column:
    """A byte for each line up to the last that goes: 1 if it goes, else 0."""
    order = F.sort_array(gone)
    steps = F.zip_with(order, F.concat(F.array(F.lit(-1)), order), lambda x, was: F.when(x.isNull(), "").otherwise(F.concat(F.repeat(F.lit("0"), x - was - 1), F.lit("1"))))
    return F.array_join(steps, "").cast("binary")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with the text's repeated lines taken out, and the columns as they are; _n_lines and _n_gone besides."""
    lost = dropped_lines(docs, id_col=id_col, text_col=text_col, **kw).select(F.col("id").alias("_id"), F.col("row").alias("_row"), _mask(F.col("gone")).alias("_mask"), F.size("gone").alias("_gone"))
    own, _, names = own_names(without(docs, "_n_lines", "_n_gone"))
    text = F.col(names[text_col])
    lost = Scratch(docs.sparkSession, "lost").write(lost, "lost")
    touched, whole = apart(own.withColumn("_key", F.xxhash64(text.cast("string"))), F.col("_key"), lost, F.col("_row"))
    joined = touched.join(lost, F.col(names[id_col]).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_row")), "left")
    joined = joined.unionByName(whole, allowMissingColumns=True)
    lines = F.split(text, "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: F.coalesce(F.substring("_mask", i + 1, F.lit(1)), F.lit(b"")) != F.lit(b"1")), "\n")
    new = F.when(F.col("_mask").isNull(), text).otherwise(kept)
    return joined.select(*[(new if c == text_col else F.col(n)).alias(c) for c, n in names.items()], F.coalesce(F.size(lines), F.lit(0)).alias("_n_lines"), F.coalesce("_gone", F.lit(0)).alias("_n_gone"))


def keep_new_text(docs: DataFrame, *, text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without repeated lines, and without the documents of which no text is left; same columns."""
    own, back, names = own_names(docs)
    own = dedup_lines(own, text_col=names[text_col], **(kw | {"id_col": names[kw.get("id_col", "doc_id")]}))
    emptied = (F.col("_n_gone") > 0) & (F.trim(F.regexp_replace(names[text_col], r"\n", "")) == "")
    return own.where(~F.coalesce(emptied, F.lit(False))).select(*back)
