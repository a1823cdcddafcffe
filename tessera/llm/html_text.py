"""Main text of a web page by line-block distribution.

Markup is stripped to lines, one for each block; a boilerplate element (menu, header or footer outside the
article, sidebar, form, script, advert, notice, reader comments: by tag name, or by class, id and role)
leaves an empty line, and so does a block outside an article that is mostly links. Lengths are summed over
sliding windows of ``WINDOW`` lines: text surges where a sum rises from zero and dives where it falls to
zero again. On a page without an article or main element, the runs of lines between those points are kept from
the first to the last one in which a window reaches ``SURGE`` characters; failing that, the longest run is. On a
page with one, membership is a weight: the articles' lines count ``LEAN`` times against the largest part outside,
between a surge and a dive or an article's border. If that part still outweighs them all, they are teasers and the
page is taken as one without; otherwise they stay, and so does each part outside that surges and is at least as long
as the longest article. Where there is neither element, a div or section named like one stands for it, unless a part
outside is longer than all of these. A form is boilerplate unless an article lies in it or it holds most of the text.

Defined results: a null or empty page, and one without text, gives ""; tags that are never closed are
ignored as containers (script and style run to the end); rows that repeat are extracted one by one; an
empty table gives none. Input columns named like a result are replaced.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import small_batches, without

WINDOW, SURGE = 3, 80
#: What a character in an article weighs against one outside.
LEAN = 4
RESULTS = ("text", "n_chars")
MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^<>]*>"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|svg|iframe|select|button|object|noframes)\b[^>]*(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z))"
    r"|<(?P<end>/?)(?P<name>[a-z][^\s/>]*)(?P<attrs>(?>[^<>\"']+|\"[^\"]*\"|'[^']*')*+|[^<>]*)>",
    re.I | re.S,
)
#: Their text belongs to the line around them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("nav aside footer form head menu dialog".split())
ARTICLE = frozenset(("article", "main"))
ATTR = re.compile(r"(?:^|\s)(class|id|role|itemprop|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+|[0-9]+")
#: Words in a class, id or role that mark boilerplate.
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense advertorial sponsor sponsored sponsors promo promos promoted promotion banner banners cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login "
    "sidebar sidebars aside rail widget widgets related recommended recommendations recommend teaser teasers trending popular comment comments commentlist disqus respond reply replies share sharing social "
    "nav navbar navigation navigations menu menus breadcrumb breadcrumbs pagination pager toc footer foot copyright masthead topbar toolbar skip search searchbox contentinfo complementary form disclaimer paywall outbrain taboola".split()
)
#: Of these, the ones that hold even beside a name of the main text, as in "article-comments".
STRONG = frozenset("ad ads adv advert adverts advertisement advertising sponsored promo comment comments related share sharing sidebar nav navigation menu footer cookie cookies newsletter disqus respond reply".split())
MAIN = frozenset("article content main story".split())
#: Words that say nothing: with one of any other kind beside it ("related-work", "social-history"), a word above marks nothing.
PLAIN = frozenset("a area b bar block blocks body bottom box button buttons by c card center col column container element entry fixed fluid form frame header holder icon icons image in inline inner item items js label layer left lg line link links list mini mobile module more new news o of on outer page panel part placeholder pop position post posts right row section site slot sm space spot sticky strip tab text the title to top ul unit up us user users view web wide wrap wrapper zone".split())
#: Names of the element that holds the main text where there is no article or main element.
HOLDERS = MAIN | frozenset("post entry articlebody".split())
HEADER = frozenset(("header", "masthead", "banner"))


def _is_boilerplate(name: str, attrs: str, in_article: bool, wraps: bool, hints: bool) -> bool:
    """wraps: an article or main element lies in it."""
    if name in DROPPED and name != "form":
        return name != "head" or not wraps
    if name == "header":
        return not in_article
    if not hints or not attrs or wraps or name in ("body", "html", "main"):
        return False
    for key, a, b, c in ATTR.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "hidden" or key == "itemprop" and value.lower() == "comment":
            return True
        if key in ("class", "id", "role"):
            for token in value.split():
                words = {w for w in WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if not w.isdigit()}
                if name == "form":
                    words.discard("form")
                if in_article and words - HINTS - PLAIN - MAIN:
                    continue
                if words & STRONG or words & HINTS and not words & MAIN or words & HEADER and not in_article:
                    return True
    return False


def _holds(attrs: str) -> bool:
    for key, a, b, c in ATTR.findall(attrs):
        if key.lower() != "hidden" and set(WORDS.findall((a or b or c).lower())) & HOLDERS:
            return True
    return False


def _clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def lines(page: str, hints: bool = True, named: bool = True) -> list[tuple[str, int, int]]:
    """Of each line its text, its length outside links, and a number of the outermost article it lies in or 0, below 0 for
    an element named like one, which counts if ``named``; "" for boilerplate."""
    marks = [m for m in MARKUP.finditer(page)]
    # the close tag of each open one, by name
    closes: dict[int, int] = {}
    open_at: dict[str, list[int]] = {}
    names: list[str | None] = []
    for k, m in enumerate(marks):
        name = m["name"]
        name = name.lower() if name else None
        names.append(name)
        if name and m["end"]:
            if stack := open_at.get(name):
                closes[stack.pop()] = k
        elif name:
            open_at.setdefault(name, []).append(k)
    mains = [0]  # article and main elements that begin before each mark
    for k, m in enumerate(marks):
        mains.append(mains[-1] + (names[k] in ARTICLE and not m["end"] and k in closes and not _is_boilerplate(names[k], m["attrs"], True, False, hints)))
    held = mains[-1] == 0 and hints and named
    out: list[tuple[str, int, int]] = []
    form_of: list[int] = []  # the form that each line lies in, or 0
    parts: list[str] = []
    linked: list[str] = []
    link = 0  # nesting of links
    article_ends: list[int] = []
    form_end = 0

    def add(text: str, n: int) -> None:
        out.append((text, n, (-article_ends[0] if held else article_ends[0]) if article_ends else 0))
        form_of.append(form_end)

    def flush() -> None:
        if parts:
            text = _clean(parts)
            if text:
                add(text, max(0, len(text) - len(_clean(linked))))
            parts.clear()
            linked.clear()

    at, k = 0, 0
    while k < len(marks):
        m, name = marks[k], names[k]
        if m.start() > at:
            parts.append(page[at : m.start()])
            if link:
                linked.append(parts[-1])
        at = m.end()
        if name is None:
            if m["raw"] and m["raw"].lower() not in INLINE:
                flush()
            k += 1
            continue
        if m["end"]:
            if name == "a":
                link = max(0, link - 1)
            if article_ends and article_ends[-1] == k:
                flush()
                article_ends.pop()
            if form_end == k:
                flush()
                form_end = 0
        elif k in closes and _is_boilerplate(name, m["attrs"], bool(article_ends), mains[closes[k]] > mains[k + 1], hints):
            flush()
            add("", 0)
            at = marks[closes[k]].end()
            k = closes[k] + 1
            while article_ends and article_ends[-1] < k:  # crossed tags
                article_ends.pop()
            form_end = form_end if form_end >= k else 0
            continue
        elif name == "a":
            link += k in closes
        elif name == "form" and k in closes and not form_end and mains[closes[k]] == mains[k + 1]:
            flush()
            form_end = closes[k]
        elif k in closes and (name in ARTICLE or held and name in ("div", "section", "td") and m["attrs"] and _holds(m["attrs"])):
            flush()
            article_ends.append(closes[k])
        if name == "br":
            parts.append(" ")
        elif name not in INLINE:
            flush()
            if name != "a" and not m["end"]:
                link = 0
        k += 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    size: dict[int, int] = {}
    for (text, _, _), form in zip(out, form_of, strict=True):
        size[form] = size.get(form, 0) + len(text)
    total = sum(size.values())
    return [("", 0, x[2]) if form and 2 * size[form] <= total else x for x, form in zip(out, form_of, strict=True)]


def _surged(weights: list[int]) -> list[tuple[int, int]]:
    """Runs of lines with a weight, from the first to the last one that surges; failing that, the longest."""
    runs: list[tuple[int, int]] = []
    start = None
    for i, w in enumerate([*weights, 0]):
        if w and start is None:
            start = i  # surge
        elif not w and start is not None:
            runs.append((start, i))  # dive
            start = None
    if not runs:
        return []
    sums = [0]
    for w in weights:
        sums.append(sums[-1] + w)
    peak = {r: max(sums[min(i + WINDOW, r[1])] - sums[i] for i in range(*r)) for r in runs}
    surged = [r for r in runs if peak[r] >= SURGE]
    return [r for r in runs if surged and surged[0] <= r <= surged[-1]] or [max(runs, key=lambda r: (sums[r[1]] - sums[r[0]], -r[0]))]


def _parts(weights: list[int], articles: list[int]) -> list[tuple[int, int]]:
    """Parts outside articles, each from a surge to a dive of the window sums or to an article's border."""
    parts: list[tuple[int, int]] = []
    start, last = None, 0
    for i, (w, article) in enumerate(zip([*weights, 0], [*articles, 1], strict=True)):
        if start is not None and (article or i - last > WINDOW):
            parts.append((start, last + 1))
            start = None
        if w and not article:
            start, last = i if start is None else start, i
    return parts


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = lines(page)
    if not any(t for t, _, _ in found):  # a wrapper was named like boilerplate
        found = lines(page, hints=False)
    elif any(article < 0 for _, _, article in found):
        held = sum(len(t) for t, _, article in found if article)
        outer = [0 if article or 2 * n <= len(text) else n for text, n, article in found]
        if any(sum(outer[i:j]) > held for i, j in _parts(outer, [x[2] for x in found])):
            found = lines(page, named=False)
    outer = [0 if article or 2 * n <= len(text) else n for text, n, article in found]
    length: dict[int, int] = {}
    for text, _, article in found:
        if article and text:
            length[article] = length.get(article, 0) + len(text)
    if not length:
        return " ".join(found[i][0] for r in _surged(outer) for i in range(*r))
    parts = [(sum(outer[i:j]), max(sum(outer[k : min(k + WINDOW, j)]) for k in range(i, j)), i, j) for i, j in _parts(outer, [x[2] for x in found])]
    if parts and max(parts)[0] > LEAN * sum(length.values()) and max(p[1] for p in parts) >= SURGE:
        return " ".join(found[i][0] for r in _surged(outer) for i in range(*r))
    longest = max(length.values())
    beside = {k for size, peak, i, j in parts if peak >= SURGE and size >= longest for k in range(i, j) if outer[k]}
    return " ".join(t for k, (t, _, article) in enumerate(found) if t and (article or k in beside))


def extract(pages: DataFrame, *, html_col: str = "html") -> DataFrame:
    """``pages`` without the html column, with text and n_chars (code points)."""
    small_batches(pages.sparkSession)
    pages = without(pages, *(r for r in RESULTS if r.lower() != html_col.lower()))
    keep = [c for c in pages.columns if c.lower() not in (*RESULTS, html_col.lower())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [main_text(x) for x in batch.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(got, pa.string()), pa.array([len(x) for x in got], pa.int64())], names=[*keep, *RESULTS])

    return pages.select(*keep, html_col).mapInArrow(run, pages.select(*keep).schema.add("text", "string").add("n_chars", "long"))
