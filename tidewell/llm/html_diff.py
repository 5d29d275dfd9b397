"""Main text of web pages: nearest-URL page differencing over text lines.

A page is read into lines (its blocks, those of menus and adverts included). Each page is paired with the page of the
same host whose URL path is nearest in order; their lines are aligned by longest common subsequence, and
shared lines are template. What differs is the text, but for two mistakes of differencing: menus, adverts and footers that
differ from page to page stay, and paragraphs that two articles share go. An exact check by containers mends them in
each page's differences: lines of menus, headers, footers, sidebars, notices, adverts, forms and comments go,
lines inside an article (or main) element come back; where a page has such an element nothing
outside of it is text. Scripts and styles give no lines.

White space in a block becomes one space, blocks are joined by two newlines; a line break element is
white space. Null and empty html give an empty text. Rows that repeat a page_id get each their
own text; rows without page_id or host are not paired.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Collection
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import list_array, map_batches, prepare, text_bytes
from .host_reputation import url_parts

#: All repetitions are possessive, so a tag is read in one pass. Without quotes is for what an unclosed quote has spoilt.
_REST = r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)"""
_TAG = re.compile(_REST + r"""((?:"[^"]*+"|'[^']*+'|[^'">]++)*+)>""", re.S)
_TAG_WITHOUT_QUOTES = re.compile(_REST + r"""([^>]*+)>""", re.S)
_ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr "
    "math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe object svg select canvas audio video noframes".split())
_CHROME = frozenset("nav footer aside form menu dialog button fieldset head".split())
_MAIN = frozenset(("article", "main"))
_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "footer masthead comment comments disqus reply replies respond share sharing social related recommended recommendations newsletter subscribe subscription signup popup modal overlay widget pagination pager toolbar login copyright".split()
)
#: Words that only say where or how: with a name from above they make a name, other words make another thing of it.
_AROUND = frozenset("area article articles bar block body bottom box buttons container content count footer form group header icons inner inline item items left links list main outer page post posts reader right row section site slot sticky stories story text thread title top unit user wrap wrapper".split())
#: Names of adverts and reader comments, whatever words stand beside them, of an element that groups others.
_ALWAYS = frozenset("ad ads adv advert adverts advertisement advertising adsbygoogle adsense sponsored promo banner comments commentlist commentform disqus".split())
#: Words that turn a name from above into something else.
_NOT = frozenset("has with no without hoc hominem lib infinitum".split())
_GROUPS = frozenset("div section ul ol aside ins table article figure".split())
#: Elements whose id is the target of a link to a place in the text.
_PLACES = frozenset("h1 h2 h3 h4 h5 h6 p section li dt dd blockquote pre figure table a span".split())
#: An article that holds less than this part of the longest one's text stands beside it to lead elsewhere.
TEASER = 0.25
_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar toolbar".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _is_chrome(tag: str, attributes: str, in_main: bool) -> bool:
    if tag in _CHROME or tag == "header" and not in_main:
        return True
    if not attributes or tag in ("html", "body"):
        return False
    given = {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
    if given.get("role", "").lower() in _ROLES or given.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", given.get("style", "")):
        return True
    if re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", _QUOTED.sub("", attributes)):
        return True
    of = {k: [{w.lower() for w in _WORDS.findall(name)} for name in given.get(k, "").split()] for k in ("class", "id")}
    if in_main:  # a paragraph on a notice period is none of the notices, a heading that links lead to is no menu
        if tag in _GROUPS and (any(words & _ALWAYS and not words & _NOT for words in of["class"]) or any(words - _AROUND and words - _AROUND <= _ALWAYS for words in of["id"])):
            return True
        judged = of["class"] if tag in _PLACES else of["class"] + of["id"]
        return any(words & _NAMES and not {w for w in words if not w.isdigit()} - _NAMES - _AROUND for words in judged)
    return any(words & _NAMES or "header" in words for words in of["class"] + of["id"])


def _tags(page: str):
    """All tags, comments and the like from left to right; what an unclosed quote spoils is read without regard to quotes."""
    pattern, at, last = _TAG, 0, page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        m = pattern.match(page, at) if at < last or page.startswith("<!", at) else None
        if m is None and at < last and pattern is _TAG and page[at + 1 : at + 3].strip("/")[:1].isalpha():
            m = _TAG_WITHOUT_QUOTES.match(page, at)
            if m is not None:
                pattern = _TAG_WITHOUT_QUOTES
        if m is None:
            at += 1
            continue
        at = (yield m) or m.end()


def lines_of(page: str | None) -> list[tuple[str, bool]]:
    """(text, inside an article) of each block that is not in a menu, advert and the like, nor in a short article beside a long one."""
    lines = all_lines(page)
    return [(text, number > 0) for (text, number, _), claim in zip(lines, _claims(lines), strict=True) if claim is not False]


def _claims(lines: list[tuple[str, int, bool]]) -> list[bool | None]:
    """What containers say of each line: in an article (true), in a menu, advert, teaser and the like (false), or nothing."""
    held: Counter[int] = Counter()
    for text, number, chrome in lines:
        held[number] += len(text) if number and not chrome else 0
    least = TEASER * max(held.values(), default=0)
    return [False if chrome or number and held[number] < least else True if number else None for _, number, chrome in lines]


def text_of(page: str | None, shared: Collection[int]) -> tuple[str, int, int]:
    """Main text, number of lines, and of those whose hash is in ``shared``: differencing, then the check by containers."""
    lines = all_lines(page)
    template = [bool(shared) and line_hash(text) in shared for text, _, _ in lines]
    claims = _claims(lines)
    if True in claims:
        claims = [claim is True for claim in claims]
    kept = [text for (text, _, _), gone, claim in zip(lines, template, claims, strict=True) if (not gone if claim is None else claim)]
    return "\n\n".join(kept), len(lines), sum(template)


def all_lines(page: str | None) -> list[tuple[str, int, bool]]:
    """(text, number of the outermost article it is in, from 1, or 0, in a menu, advert and the like) of each block."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, int]] = []  # tag, chrome, number of the article
    articles = 0
    opened: Counter[str] = Counter()
    said: tuple[list[str], list[str]] = ([], [])  # by whether it is in a menu and the like
    state = [False, 0]

    def close() -> None:
        for chrome, parts in enumerate(said):
            line = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if line:
                out.append((line, state[1], bool(chrome)))

    page, at = page or "", 0
    tags = _tags(page)
    m = next(tags, None)
    while m is not None:
        said[state[0]].append(page[at : m.start()])
        at, skip = m.end(), None
        tag = (m[2] or "").lower()
        if tag and tag not in _INLINE:
            close()
        elif tag == "br":
            said[state[0]].append(" ")
        if m[1]:
            while opened[tag]:
                top = stack.pop()[0]
                opened[top] -= 1
                if top == tag:
                    break
        elif tag in _RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = skip = end.end() if end else len(page)
        elif tag and tag not in _VOID and not m[3].endswith("/"):
            chrome, main = stack[-1][1:] if stack else (False, 0)
            skipped = chrome or _is_chrome(tag, m[3], main > 0)
            if tag in _MAIN and not main:
                articles += 1
                main = articles
            stack.append((tag, skipped, main))
            opened[tag] += 1
        state[:] = stack[-1][1:] if stack else (False, 0)
        try:
            m = tags.send(skip)
        except StopIteration:
            m = None
    said[state[0]].append(page[at:])
    close()
    return out


def line_hash(line: str) -> int:
    return xxhash.xxh3_64_intdigest(line.encode(errors="surrogatepass")) - (1 << 63)


#: Cells of the largest table of pairs of lines that an alignment holds.
_TABLE_CELLS = 4_000_000


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """How long a common subsequence of ``a`` and each beginning of ``b`` can be."""
    right, row = np.array(b), np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        np.maximum.accumulate(np.where(right == x, row[:-1] + 1, row[1:]), out=row[1:])
    return row


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """A longest common subsequence of two line lists, over the lines that both hold.

    Where a table of all pairs would be large, the first list is halved and the second cut where the best lengths of both
    halves add up to most, so that space grows with the lines and not with their product.
    """
    both = set(a) & set(b)
    a, b = [x for x in a if x in both], [x for x in b if x in both]
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    if same:
        return a[:same] + common_lines(a[same:], b[same:])
    if not a or not b:
        return []
    if len(a) > 1 and len(a) * len(b) > _TABLE_CELLS:
        half = len(a) // 2
        cut = int((_lengths(a[:half], b) + _lengths(a[half:][::-1], b[::-1])[::-1]).argmax())
        return common_lines(a[:half], b[:cut]) + common_lines(a[half:], b[cut:])
    right = np.array(b)
    table = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    for i, x in enumerate(a, 1):
        match = np.where(right == x, table[i - 1, :-1] + 1, table[i - 1, 1:])
        np.maximum.accumulate(match, out=table[i, 1:])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1] and table[i, j] == table[i - 1, j - 1] + 1:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif table[i - 1, j] >= table[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def _outline(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Hashes of all lines of a page."""
    hashes = [np.array([line_hash(text) for text, _, _ in all_lines(p)], dtype=np.int64) for p in batch.column(1).to_pylist()]
    return pa.RecordBatch.from_arrays([batch.column(0), list_array(hashes, pa.int64())], ["page_id", "lines"])


def _nearest(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Of the pages before and after in URL order, the one that shares more of the path."""
    near = []
    for row in batch.to_pylist():
        best = None
        for side in ("before", "after"):
            other = row[side]
            if other is not None and other["host"] == row["host"]:
                shared = len(commonprefix([row["path"], other["path"]]))
                if best is None or shared > best[0]:
                    best = (shared, other["page_id"])
        near.append(best and best[1])
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(near, pa.int64())], ["page_id", "near"])


def nearest_pages(pages: DataFrame) -> DataFrame:
    """(page_id, near): the page of the same host with the nearest URL path.

    Pages are range-partitioned by host and path, so a large host spreads over partitions;
    neighbours across the edge of a partition come from a table with one row a partition.
    """
    host, path = url_parts(F.col("url"))
    order = ["host", "path", "page_id"]
    keys = pages.where("page_id IS NOT NULL").select(host.alias("host"), path.alias("path"), "page_id").where("host <> ''").distinct()
    keys = keys.repartitionByRange(*order).withColumn("part", F.spark_partition_id()).checkpoint()
    entry = F.struct(*order)
    edges = keys.groupBy("part").agg(F.min(entry).alias("first"), F.max(entry).alias("last"))
    by_part = Window.orderBy("part")
    edges = edges.select(F.col("part").alias("edge"), F.lag("last").over(by_part).alias("edge_before"), F.lead("first").over(by_part).alias("edge_after"))
    inside = Window.partitionBy("part").orderBy(*order)
    placed = keys.withColumn("before", F.lag(entry).over(inside)).withColumn("after", F.lead(entry).over(inside))
    placed = placed.join(edges, placed.part == edges.edge).select("page_id", "host", "path", F.coalesce("before", "edge_before").alias("before"), F.coalesce("after", "edge_after").alias("after"))
    return map_batches(placed, _nearest, "page_id long, near long").where("near IS NOT NULL").groupBy("page_id").agg(F.min("near").alias("near"))


def _shared(batch: pa.RecordBatch) -> pa.RecordBatch:
    shared = [common_lines(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shared, pa.list_(pa.int64()))], ["page_id", "near", "shared"])


def template_lines(pages: DataFrame) -> DataFrame:
    """(page_id, near, shared) of every page with a nearest page: hashes of all lines that it shares with it, in the order of the alignment."""
    outlines = map_batches(pages.where("page_id IS NOT NULL").select("page_id", "html"), _outline, "page_id long, lines array<long>")
    outlines = outlines.groupBy("page_id").agg(F.max("lines").alias("lines")).checkpoint()
    other = outlines.select(F.col("page_id").alias("near"), F.col("lines").alias("near_lines"))
    both = outlines.join(nearest_pages(pages), "page_id").join(other, "near").select("page_id", "near", "lines", "near_lines")
    return map_batches(both, _shared, "page_id long, near long, shared array<long>")


def _packed(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Html compressed, as it crosses the shuffle."""
    pages = pa.array([zlib.compress(page, 1) for page in text_bytes(batch.column(2))], pa.binary())
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pages, batch.column(3)], ["page_id", "url", "packed", "spread"])


def _extract(batch: pa.RecordBatch) -> pa.RecordBatch:
    pages = (zlib.decompress(page).decode() for page in batch.column(2).to_pylist())
    found = [text_of(page, set(shared or ())) for page, shared in zip(pages, batch.column(4).to_pylist(), strict=True)]
    texts, lines, shared = ([f[i] for f in found] for i in range(3))
    longs = [pa.array(x, pa.int64()) for x in ([len(t) for t in texts], lines, shared)]
    columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), longs[0], batch.column(3), *longs[1:]]
    return pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "near_id", "n_lines", "n_shared"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, near_id, n_lines, n_shared of every row of ``pages(page_id, url, html)``.

    near_id is the page that a row was held against (null: none), n_lines counts its lines, n_shared those of them that
    differencing takes for template. Each page meets its own differences in a shuffle; rows without page_id, which meet none, are spread.
    """
    prepare(pages.sparkSession)
    template = template_lines(pages).select(F.col("page_id").alias("of_page"), "near", "shared", F.lit(0).cast("long").alias("of_spread"))
    spread = F.when(F.col("page_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0)).cast("long")
    pages = map_batches(pages.select("page_id", "url", "html", spread.alias("spread")), _packed, "page_id long, url string, packed binary, spread long")
    same = (F.col("page_id") == F.col("of_page")) & (F.col("spread") == F.col("of_spread"))
    joined = pages.join(template.hint("shuffle_hash"), same, "left").select("page_id", "url", "packed", "near", "shared")
    return map_batches(joined, _extract, "page_id long, url string, text string, n_chars long, near_id long, n_lines long, n_shared long")
