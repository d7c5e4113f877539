"""The main text of web pages: each page is held against the pages of its host whose addresses are nearest, and lines that
both have in the same order are taken for the template.

The text lines of a page and of its neighbours by path are aligned by their longest common subsequence, and shared lines
are deleted. What a page says about itself is believed before that: text inside an article or main element is the
article's though other pages quote it, and what its markup calls a menu, a header, a footer, a sidebar, a notice, an advert,
a form or comments is none of it though no neighbour has it.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import stable

#: A neighbour that has this share of the lines of the shorter page, templates left out, is a copy and tells nothing.
COPY_SHARE = 0.8
#: Bits of the rows that an alignment may hold; a larger one is halved first.
ALIGNED_BITS = 1 << 28

# Fixed names of HTML. Elements whose content is no text, elements that never have content, elements within a line.
_RAW = "script|style|template|textarea|iframe|noembed|noframes|svg|math|object|canvas|audio|video|title|select"
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_CHROME = frozenset("nav header footer aside form head button menu dialog noscript fieldset".split())
_CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# Words of class names and ids.
_CHROME_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe signup nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar aside header masthead topbar footer colophon comment comments disqus replies "
    "respond share sharing social related recommended search login form pagination pager toolbar copyright".split()
)
_COMMENT_WORDS = frozenset("comment comments disqus reply replies respond".split())
_WHOLE_WORDS = frozenset("wrap wrapper container layout page site with has no without is grid row col".split())
_MAIN_NAMES = re.compile(r"(?:^|[-_])(?:article|post|entry|story|main|page)[-_]?(?:body|content|text)$|^(?:article|post|entry|story|content|main)$")

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>])[^<>]*>.*?(?:</(?P=raw)\s*>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/<>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*)>|</?[a-z][^<>]*>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


@dataclass
class Line:
    """A line of a page. chrome: its markup says that it is no part of an article. main: it stands inside the article."""

    text: str
    chrome: bool
    main: bool
    named: bool  # inside an element that only its class or id calls the article


def _states(tag: str, attrs: str) -> tuple[bool, bool, bool]:
    """What an element's start says of its content: (chrome, main, named)."""
    chrome, main, named = tag in _CHROME, tag in ("article", "main"), False
    if "=" not in attrs:
        return chrome, main, named
    for name, *values in _ATTRIBUTE.findall(attrs):
        name, value = name.lower(), html.unescape("".join(values))
        if name == "role":
            roles = value.lower().split()
            chrome |= bool(_CHROME_ROLES.intersection(roles))
            main |= "main" in roles or "article" in roles
        elif name == "itemprop":
            main |= "articlebody" in value.lower().split()
            chrome |= "comment" in value.lower().split()
        elif name in ("class", "id"):
            for given in value.split():
                words = {w.lower() for w in _WORDS.findall(given)}
                comment = bool(words & _COMMENT_WORDS) and not words & _WHOLE_WORDS
                if tag in ("article", "main"):
                    chrome, main = chrome or comment, main and not comment
                elif tag not in ("html", "body"):
                    chrome |= bool(words & _CHROME_WORDS) and not words & _WHOLE_WORDS
                    named |= bool(_MAIN_NAMES.search(given.lower()))
    return chrome, main and not chrome, named and not chrome


def lines_of(source: str) -> list[Line]:
    """The lines of text of a page in their order: character references decoded, white space made one space, empty lines
    left out. A block, and a line break, ends a line."""
    out: list[Line] = []
    stack: list[tuple[str, tuple[bool, bool, bool]]] = []
    open_: Counter[str] = Counter()
    state = (False, False, False)
    held: list[str] = []

    def end_line():
        if held:
            if text := " ".join(html.unescape("".join(held)).split()):
                out.append(Line(text, *state))
            held.clear()

    def pop_to(tag: str):
        nonlocal state
        while True:
            name, _ = stack.pop()
            open_[name] -= 1
            if name == tag:
                break
        state = stack[-1][1] if stack else (False, False, False)

    at = 0
    for m in _TOKEN.finditer(source):
        if m.start() > at:
            held.append(source[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            if m["raw"] and m["raw"].lower() == "title":
                end_line()
            continue
        tag = tag.lower()
        if m["end"]:
            if open_[tag]:
                if tag not in _INLINE:
                    end_line()
                elif state != (stack[-2][1] if len(stack) > 1 else (False, False, False)):
                    end_line()
                pop_to(tag)
            elif tag not in _INLINE:
                end_line()
            continue
        if tag not in _INLINE:
            end_line()
        if tag in _CLOSES_P and open_["p"]:  # an open paragraph ends where a block begins
            for name, _ in reversed(stack):
                if name == "p":
                    pop_to("p")
                    break
                if name not in _INLINE:
                    break
        if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            pop_to(tag)
        if tag in _VOID or m["attrs"].endswith("/"):
            continue
        said = _states(tag, m["attrs"])
        if any(said):
            now = (state[0] or said[0], (state[1] or said[1]), (state[2] or said[2]))
            if now != state:
                end_line()  # what stands before belongs outside
        else:
            now = state
        stack.append((tag, now))
        open_[tag] += 1
        state = now
    held.append(source[at:])
    end_line()
    return out


def _row(row: int, match: int, full: int) -> int:
    """The next row of the bit-parallel table: zero bits are where the common subsequence grows."""
    both = row & match
    return ((row + both) | (row - both)) & full


def _growth(a: list, b: list) -> np.ndarray:
    """The length of the longest common subsequence of `a` with every prefix of `b`."""
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        row = _row(row, masks.get(x, 0), full)
    bits = np.unpackbits(np.frombuffer(row.to_bytes(-(-len(b) // 8), "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def shared(a: list, b: list) -> list[int]:
    """The places of `a` that a longest common subsequence with `b` takes. Bit-parallel rows, halved where they would be
    too many to hold (Hirschberg), so time is that of n times m bits and memory is bounded."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    known = set(b[start : len(b) - end])
    inner = [(i, x) for i, x in enumerate(a[start : len(a) - end], start) if x in known]
    own = {x for _, x in inner}
    other = [x for x in b[start : len(b) - end] if x in own]
    middle = [inner[i][0] for i in _aligned([x for _, x in inner], other)]
    return [*range(start), *middle, *range(len(a) - end, len(a))]


def _aligned(a: list, b: list) -> list[int]:
    if not a or not b:
        return []
    if len(a) == 1:
        return [0] if a[0] in b else []
    if len(a) * len(b) > ALIGNED_BITS:
        half = len(a) // 2
        cut = int((_growth(a[:half], b) + _growth(a[half:][::-1], b[::-1])[::-1]).argmax())
        return _aligned(a[:half], b[:cut]) + [half + i for i in _aligned(a[half:], b[cut:])]
    masks: dict = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | (1 << j)
    full, rows = (1 << len(b)) - 1, []
    row = full
    for x in a:
        row = _row(row, masks.get(x, 0), full)
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if not i or rows[i - 1] >> (j - 1) & 1:
                out.append(i)
                j -= 1
    return out[::-1]


def template_lines(own: list[int], marks: list[bool], neighbours: list[list[int]]) -> list[int]:
    """The places of `own`, lines as numbers, that a neighbour shares. marks: lines that markup leaves in doubt or calls
    the article's. Of a copy, which shares most of these, nothing is said."""
    found: set[int] = set()
    body = sum(marks)
    for other in neighbours:
        at = shared(own, other)
        if sum(marks[i] for i in at) < COPY_SHARE * max(1, body):
            found.update(at)
    return sorted(found)


def pieces(lines: list[Line]) -> list[tuple[int, str]]:
    """What may be main text, with the places of those lines that a template deletes; others, in one piece, have -1. With
    an article or main element only its lines are; without one, what a class or id calls the article, or else all."""
    kept = [(i, x) for i, x in enumerate(lines) if not x.chrome]
    inside = [x.text for _, x in kept if x.main]
    if inside:
        return [(-1, " ".join(inside))]
    return [(i, x.text) for i, x in ([(i, x) for i, x in kept if x.named] or kept)]


def main_text(lines: list[Line], template: set[int]) -> str:
    """The lines that are left, less the template, joined by a space. Of what remains, nothing is left out."""
    return " ".join(text for i, text in pieces(lines) if i not in template)


_ADDRESS = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^?#]*)"
_OUTLINE = "lines array<bigint>, marks array<boolean>"


def _outlines(batches):
    """Lines as numbers, behind the columns that say which page it is."""
    for batch in batches:
        lines, marks = [], []
        for source in batch.column(batch.num_columns - 1).to_pylist():
            page = lines_of(source)
            lines.append([xxhash.xxh64_intdigest(x.text) - (1 << 63) for x in page])
            marks.append([not x.chrome for x in page])
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lines, pa.list_(pa.int64())), pa.array(marks, pa.list_(pa.bool_()))], [*batch.schema.names[:-1], "lines", "marks"])


def _pieces(batches):
    """Pieces, compressed, behind the columns that say which page it is. Their texts have no line breaks."""
    for batch in batches:
        places, texts = [], []
        for source in batch.column(3).to_pylist():
            page = pieces(lines_of(source))
            places.append([i for i, _ in page])
            texts.append(zlib.compress("\n".join(text for _, text in page).encode()))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(places, pa.list_(pa.int32())), pa.array(texts, pa.binary())], [*batch.schema.names[:3], "places", "texts"])


def _templates(batches):
    for batch in batches:
        own, marks, before, after = (batch.column(i).to_pylist() for i in (3, 4, 5, 6))
        found = [template_lines(o, m, [x for x in (p, n) if x is not None]) for o, m, p, n in zip(own, marks, before, after, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names[:3], "template"])


def _placed(outlines: DataFrame) -> DataFrame:
    """`outlines` with `place`, their number in the order of host and path: by ranges, with the counts of earlier ranges
    added. No host or path is gathered in one task."""
    order = ["host", "path", "url", "page_id", "digest"]
    ranged = stable(outlines.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each range
    starts = counts.select("part", F.coalesce(before, F.lit(0)).alias("start"))
    return ranged.withColumn("inside", inside).join(F.broadcast(starts), "part").select("host", "page_id", "url", "digest", "lines", "marks", (F.col("start") + F.col("inside")).alias("place"))


def templates(pages: DataFrame) -> DataFrame:
    """(page_id, url, digest, template) for pages (page_id, url, html) that share lines with a neighbour: the places of
    those lines. A neighbour is the page before or behind in the order of paths of the same host."""
    host, path = F.lower(F.regexp_extract("url", _ADDRESS, 1)), F.regexp_extract("url", _ADDRESS, 2)
    told = pages.select("page_id", "url", F.xxhash64("html").alias("digest"), host.alias("host"), path.alias("path"), F.coalesce("html", F.lit("")).alias("html"))
    told = told.where(F.col("host") != "")
    outlines = told.mapInArrow(_outlines, f"page_id bigint, url string, digest bigint, host string, path string, {_OUTLINE}")
    placed = _placed(outlines.where(F.size("lines") > 0).dropDuplicates(["page_id", "url", "digest"]))
    beside = lambda name, step: placed.select(F.col("host").alias(f"{name}_host"), F.col("lines").alias(name), (F.col("place") + step).alias("place"))
    near = placed.join(beside("before", 1), "place", "left").join(beside("after", -1), "place", "left")
    of_host = lambda name: F.when(F.col(f"{name}_host") == F.col("host"), F.col(name)).alias(name)
    near = near.select("page_id", "url", "digest", "lines", "marks", of_host("before"), of_host("after")).where("before is not null or after is not null")
    return near.mapInArrow(_templates, "page_id bigint, url string, digest bigint, template array<int>").where(F.size("template") > 0)


def main_texts(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, n_template: the main text of each row of `df`, its code points, and how many lines of the
    page its neighbours share.

    A row in, a row out: repeated rows are given again. A null page is empty; a page without text has an empty one. A page
    without an address, or alone on its host, has no neighbours, so only its markup says what goes. Pages that are alike
    in address are neighbours of each other, in the order of id and content. A line is kept or left out whole, whatever
    its length. Columns beside the three are ignored; an empty table gives an empty result.
    """
    pages = df.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    found = templates(pages)
    named = pages.select("page_id", "url", F.xxhash64("html").alias("digest"), F.coalesce("html", F.lit("")).alias("html"))
    keyed = named.mapInArrow(_pieces, "page_id bigint, url string, digest bigint, places array<int>, texts binary")  # much less to move than html
    same = keyed["page_id"].eqNullSafe(found["page_id"]) & keyed["url"].eqNullSafe(found["url"]) & (keyed["digest"] == found["digest"])
    both = keyed.join(found, same, "left").select(keyed["page_id"], keyed["url"], found["template"], keyed["places"], keyed["texts"])

    def run(batches):
        for batch in batches:
            template, places, packed = (batch.column(i).to_pylist() for i in (2, 3, 4))
            texts = []
            for t, at, z in zip(template, places, packed, strict=True):
                gone = set(t or [])
                texts.append(" ".join(text for i, text in zip(at, zlib.decompress(z).decode().split("\n"), strict=False) if i not in gone))
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t or []) for t in template], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_chars", "n_template"])

    return both.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint, n_template bigint")
