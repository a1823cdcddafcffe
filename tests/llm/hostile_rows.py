"""Documents with hostile column names and values, shared by the operators' tests."""

HOSTILE = "c0 c1 _id _row row gone _gone _text place size taken copies component comp cid band h score n_words items spans _n_gone _key first".split()


def hostile(spark, rows, kind="doc_id long, text string, source string"):
    """Rows with other columns named like an operator's own; each holds its name and the row's number."""
    n = len(kind.split(","))
    schema = kind + "".join(f", {c} string" for c in HOSTILE)
    return spark.createDataFrame([(*r[:n], *[f"{c}{i}" for c in HOSTILE]) for i, r in enumerate(rows)], schema)


def own_values(row, but=()):
    """The number that all of a row's other columns agree on."""
    got = {row[c].removeprefix(c) for c in HOSTILE if c not in but and c in row.asDict()}
    assert len(got) == 1, got
    return int(got.pop())
