"""Main text of pages, and WARC archives there and back."""

import base64
import gzip
import hashlib
import random
import time

import pytest

from tessera.llm import html_text, warc
from tessera.llm.common import Scratch

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header><a href="/">Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<article><h1>A &amp; B</h1><p>First <b>para</b>graph &#233;&nbsp;with
 white   space.</p><div class="ad-banner">Buy now</div><p>Second<br>line.</p><section class="comments"><p>I disagree</p></section></article>
<aside>Related</aside><footer>&copy; 2024</footer></body></html>"""


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (PAGE, "A & B First paragraph é with white space. Second line."),
        (None, ""),
        ("", ""),
        ("plain text only", "plain text only"),
        ("<p>unclosed <b>tags<p>next one", "unclosed tags next one"),
        ("<div class='sidebar'>x</div><div id='content'><p>Main text here.</p></div>", "Main text here."),
        ("<script>never closed", ""),
        ("<!-- c --><p>a < b &lt; c</p>", "a < b < c"),
        ("<body><form><p>sign up</p></form><main><p>Kept.</p></main></body>", "Kept."),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


BODY = "".join(f"<p>Paragraph {i} of the body, with enough words in it to surge over a window.</p>" for i in range(12))
BODY_TEXT = " ".join(f"Paragraph {i} of the body, with enough words in it to surge over a window." for i in range(12))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<div>{BODY}</div><aside>x</aside><article><h3>Teaser</h3><p>Read more of it.</p></article>", BODY_TEXT),
        (f"<article><p>{'Intro words. ' * 20}</p></article><div>{BODY}</div>", ("Intro words. " * 20) + BODY_TEXT),
        (f"<div>{BODY[: len(BODY) // 2]}<div class=ad>x</div>{BODY[len(BODY) // 2 :]}</div><article><p>Teaser.</p></article>", None),
        (f"<p>A line of some words about the site, its owners and its terms, long enough to surge.</p><article>{BODY}</article>", BODY_TEXT),
    ],
)
def test_windows_choose_between_articles_and_the_rest(page, text):
    got = html_text.main_text(page)
    assert got == text if text else "Paragraph 0 " in got and "Paragraph 11 " in got and "Teaser" not in got


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f'<div class="post-title"><h1>Title</h1></div><div class="text">{BODY}</div>', f"Title {BODY_TEXT}"),
        ('<div class="post-title"><h1>Title</h1></div><div class="text"><p>A short body.</p></div>', "Title A short body."),
        (f'<div class="post">{BODY}</div><div class="text"><p>Some words beside it.</p></div>', BODY_TEXT),
        (f'<body><form id="aspnetForm" action="x"><nav>Menu</nav><div>{BODY}</div></form></body>', BODY_TEXT),
        (f"<body><main><form>{BODY}</form></main></body>", BODY_TEXT),
        (f"<body><div>{BODY}</div><form><p>Sign up here for our letter, which comes each week and can be cancelled at any time.</p></form></body>", BODY_TEXT),
    ],
)
def test_a_name_or_form_does_not_outweigh_most_of_the_text(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize(
    "tag",
    ['section id="related-work"', 'section class="discussion"', 'div class="social-history"', 'p data-x="' + "x" * 9000 + ' > leak < y"', "p title='" + "y" * 20_000 + " <b> leak'"],
)
def test_text_of_an_article_stays(tag):
    got = html_text.main_text(f"<body><article><p>Before it.</p><{tag}>A part of the text.</{tag.split()[0]}><p>After it.</p></article></body>")
    assert got == "Before it. A part of the text. After it."


@pytest.mark.parametrize("tag", ['div class="ad"', 'div class="related-posts widget"', 'div id="comments-2"', 'div class="newsletterSignup"', 'div class="x share-buttons"'])
def test_named_boilerplate_in_an_article_goes(tag):
    got = html_text.main_text(f"<body><article><p>Before it.</p><{tag}>Not of the text.</{tag.split()[0]}><p>After it.</p></article></body>")
    assert got == "Before it. After it."


def test_results_take_the_place_of_columns_whatever_their_case(spark):
    from tessera.llm import decontaminate, tokens

    df = spark.createDataFrame([(1, "<p>ab</p>", "x")], "page_id long, html string, Text string")
    assert html_text.extract(df).first()["text"] == "ab"
    docs = spark.createDataFrame([(1, "a b", 5, 6)], "doc_id long, text string, N_hit int, N_Tokens int")
    assert tokens.count_tokens(docs).select("n_tokens").first()[0] > 0
    assert decontaminate.find_contamination(docs, spark.createDataFrame([(1, "b")], "item_id long, text string")).select("n_hit").first()[0] == 1


def test_broken_pages_take_linear_time():
    for page in ("<" * 200_000, "<a " * 60_000, '<div class="' * 40_000, "<p>" * 60_000, "<div>" * 60_000 + "x", "&amp;" * 100_000):
        start = time.process_time()
        html_text.main_text(page)
        assert time.process_time() - start < 20


def test_extract(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "t"), (2, None, None, "t"), (2, None, None, "t"), (3, "v", "<p>é𝄞</p>", None)], "page_id long, url string, html string, text string")
    got = html_text.extract(df).collect()
    assert [r["n_chars"] for r in got] == [len(r["text"]) for r in got] and got[1]["text"] == "" and got[3]["n_chars"] == 2
    assert html_text.extract(df.limit(0)).count() == 0


def test_round_trip(spark):
    rng = random.Random(1)
    same = "<p>copy</p>"
    rows = [(i, f"http://h/{i}", rng.choice([same, "", f"<p>page {i} é\r\n\r\n WARC/1.1 {'x' * rng.randrange(9000)}</p>"])) for i in range(60)]
    rows += [(100, None, None), (101, "http://h/a b\n", same), (3, "http://h/3b", same), (None, "http://h/null", same), (200, "u", "z" * 3_000_000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, refers_to string")
    got = sorted((tuple(r) for r in warc.round_trip(spark, df).collect()), key=str)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = []
    for i, u, h in rows:
        raw = (h or "").encode()
        kind = "response" if first[h or ""] == i else "revisit"
        want.append((i, {"http://h/a b\n": "http://h/a%20b%0A"}.get(u, u), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), kind, None if kind == "response" else first[h or ""]))
    assert got == sorted(want, key=str)
    assert warc.round_trip(spark, df.limit(0)).count() == 0


def test_selected_records_and_their_payloads(spark):
    scratch = Scratch(spark, "warctest")
    folder = scratch.folder("archives")
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<p>{i}</p>" * i) for i in range(50)], "page_id long, url string, html string")
    index = warc.write(warc.with_revisits(df, id_col="page_id", url_col="url", payload_col="html"), folder, scratch)
    got = {r["page_id"]: bytes(r["payload"]) for r in warc.read(index.where("page_id % 7 = 0"), folder).collect()}
    assert got == {i: (f"<p>{i}</p>" * i).encode() for i in range(0, 50, 7)}
    row = index.where("page_id = 9").first()
    raw = open(f"{folder.removeprefix('file://')}/{row['file']}", "rb").read()
    record = gzip.decompress(raw[row["offset"] : row["offset"] + row["length"]])
    assert record.startswith(b"WARC/1.1\r\n") and warc.parse(record)["url"] == "http://h/9"
    with pytest.raises(ValueError, match="damaged"):
        warc.parse(record.replace(b"<p>9", b"<p>8", 1))


def test_coalesced_reads():
    spans = [("a", 0, 10), ("a", 10, 10), ("a", 200_000, 5), ("b", 0, 5), ("b", 5, warc.READ_BYTES)]
    assert [(f, s, n, len(w)) for f, s, n, w in warc.coalesce(spans)] == [("a", 0, 20, 2), ("a", 200_000, 5, 1), ("b", 0, 5, 1), ("b", 5, warc.READ_BYTES, 1)]
    assert list(warc.coalesce([])) == []
