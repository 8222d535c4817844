"""Main text of web pages: marked articles, and nearest-URL page differencing for the rest.

Every page is cut into lines (the text of its blocks). Within a host, pages are sorted by URL path;
the neighbour that shares the longest beginning of the path is a page's partner. The lines of both
are aligned by a longest common subsequence; lines that they share come from the site's template
and are deleted. Markup that states what a block is comes first: what lies in menus, footers,
adverts and the like always goes, and what lies in a marked article always stays, since copies and
quotations would otherwise be deleted as template. A class, id or role names chrome only as a whole:
each of its words is one of chrome or says where or how it stands, and headings, the article itself
and, but for comments, what holds most of the page's text are never chrome by name.
"""

from __future__ import annotations

import html
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.arrow import map_batches
from folio.llm.shared import written

#: Elements that are never main text.
CHROME = frozenset("nav header footer aside form script style noscript template iframe svg button select textarea menu dialog head object canvas audio video".split())
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title noscript iframe".split())
#: Elements that hold the main text.
MAIN = frozenset("article main".split())
#: Elements that class words never make chrome; their ids are made from their text.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that don't break a line.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id or role that name a block which isn't main text.
CHROME_WORDS = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice popup promo promoted related replies reply respond share sharing sidebar social sponsor sponsored subscribe toolbar widget contentinfo complementary search".split())

_TAG = re.compile(r"""<(?:!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)|/?[a-zA-Z][^>]*(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""(?<![^\s/"'])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Those of them that name comments, however long.
COMMENT_WORDS = frozenset("comment comments disqus replies reply respond".split())
#: Words beside those in such a name that say where or how a block stands.
PLACES = frozenset("area bar block bottom box center col column container content fixed floating footer global header holder inner item items left list main outer overlay page panel primary region right row secondary section site slot sticky top unit wrap wrapper".split())
_WORDS = re.compile(r"[A-Za-z][a-z]*|[0-9]+")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_UNSEEN = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)")


@dataclass
class Page:
    """Lines outside chrome, each with whether it lies in a marked article."""

    lines: list[tuple[str, bool]] = field(default_factory=list)

    @property
    def marked(self) -> bool:
        return any(m for _, m in self.lines)

    @property
    def text(self) -> list[str]:
        """The lines of the article, or of the whole page where no article is marked."""
        return [x for x, m in self.lines if m] or [x for x, _ in self.lines]


def _named_chrome(name: str) -> set[str]:
    """The words by which a class, id or role, as a whole, names chrome: those of cookie-notice, adSlot or site-footer, but none of has-comments."""
    words = {w.lower() for w in _WORDS.findall(name.lower() if name.isupper() else name) if not w.isdigit()}
    return words & CHROME_WORDS if words <= CHROME_WORDS | PLACES else set()


def _chrome_names(attrs: str) -> set[str]:
    return {w for m in _NAMES.findall(attrs) for x in "".join(m).split() for w in _named_chrome(x)}


def _hidden(attrs: str) -> bool:
    """Whether attributes hide an element: hidden or aria-hidden, or a style that shows nothing."""
    for m in _ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").strip().lower()
        if name == "hidden" and value != "false" or name == "aria-hidden" and value == "true" or name == "style" and _UNSEEN.search(value):
            return True
    return False


def parse(source: str) -> Page:
    """Cut a page into lines. Broken and truncated markup is read as far as it goes, never an error."""
    page, parts = Page(), []
    open_tags: list[tuple[str, bool, bool, bool]] = []  # name, whether it starts chrome, main text, chrome by name
    opened: Counter[str] = Counter()
    named: list[int] = []  # elements around that are chrome by name
    found: list[tuple[str, bool, tuple[int, ...]]] = []
    chrome = main = n_named = 0
    comments: set[int] = set()
    at, n = 0, len(source)

    def flush() -> None:
        line = " ".join(html.unescape("".join(parts)).split())
        parts.clear()
        if line and not chrome:
            found.append((line, main > 0, tuple(named)))

    def close(upto: int) -> None:
        nonlocal chrome, main
        while len(open_tags) > upto:
            tag, c, m, x = open_tags.pop()
            opened[tag] -= 1
            chrome, main = chrome - c, main - m
            if x:
                named.pop()

    while at < n:
        m = _TAG.search(source, at)
        stop = m.start() if m else n
        if stop > at and not chrome:
            parts.append(source[at:stop])
        if not m:
            break
        at = m.end()
        if not m["name"]:
            continue
        name = m["name"].lower()
        if m["end"]:
            held = next(k for k in range(len(open_tags) - 1, -1, -1) if open_tags[k][0] == name) if opened[name] else None
            if name not in INLINE or (held is not None and any(x[1] or x[2] or x[3] for x in open_tags[held:])):
                flush()
            if held is not None:
                close(held)
            continue
        if name in ("p", "li", "tr", "td", "th", "dt", "dd", "option") and open_tags and open_tags[-1][0] == name:
            flush()
            close(len(open_tags) - 1)  # these end where the next one starts
        attrs = m["attrs"] if name not in ("html", "body") else ""
        is_chrome = name in CHROME or (bool(attrs) and _hidden(attrs))
        is_main = not is_chrome and (name in MAIN or 'role="main"' in m["attrs"] or "articleBody" in m["attrs"])
        names = _chrome_names(attrs) if attrs and not is_chrome and not is_main and name not in HEADINGS else set()
        is_named = bool(names)
        if name not in INLINE or is_chrome or is_main or is_named:
            flush()
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I).search(source, at)
            at = end.end() if end else n
            continue
        if name in VOID or m["attrs"].endswith("/"):
            continue
        open_tags.append((name, is_chrome, is_main, is_named))
        opened[name] += 1
        chrome, main = chrome + is_chrome, main + is_main
        if is_named:
            n_named += 1
            named.append(n_named)
            if not names.isdisjoint(COMMENT_WORDS):
                comments.add(n_named)
    flush()
    size: Counter[int] = Counter()
    for line, _, inside in found:
        for x in inside:
            size[x] += len(line)
    most = sum(len(line) for line, *_ in found) / 2
    page.lines = [(line, m) for line, m, inside in found if all(size[x] > most and x not in comments for x in inside)]
    return page


#: Pairs of equal lines, for each line of two pages, up to which pairs are walked one by one.
DENSE = 50


def _chained(x: list[int], places: dict[int, list[int]]) -> list[int]:
    """Indexes in ``x`` of a longest common subsequence, by chains of pairs; ``places`` are descending."""
    last: list[int] = []
    ends: list[tuple] = []
    for i, line in enumerate(x):
        for j in places.get(line, ()):  # descending, so that one line takes one place
            k = bisect_left(last, j)
            link = (i, ends[k - 1] if k else None)
            if k == len(last):
                last.append(j)
                ends.append(link)
            else:
                last[k], ends[k] = j, link
    out, link = [], ends[-1] if ends else None
    while link:
        out.append(link[0])
        link = link[1]
    return out[::-1]


def _prefix_lengths(x: list[int], y: list[int]) -> np.ndarray:
    """Length of a longest common subsequence of ``x`` and y[:j] for each j; a row of the table is one large integer."""
    places = defaultdict(list)
    for j, line in enumerate(y):
        places[line].append(j)
    masks: dict[int, int] = {}

    def mask(line: int) -> int:
        if line in masks:
            return masks[line]
        bits = np.zeros(len(y), np.uint8)
        bits[places.get(line, [])] = 1
        found = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
        if len(places.get(line, ())) > DENSE:  # few lines are as frequent, so few masks are kept
            masks[line] = found
        return found

    row = full = (1 << len(y)) - 1
    for line in x:
        hit = row & mask(line)
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Indexes in ``a`` of a longest common subsequence of ``a`` and ``b``.

    Where lines repeat so often that equal pairs are many, ``a`` is halved and ``b`` cut where both
    halves match best, so memory stays linear and a table row costs a few operations on integers.
    """
    both = set(a) & set(b)
    at = [i for i, line in enumerate(a) if line in both]
    x, y = [a[i] for i in at], [line for line in b if line in both]
    return [at[i] for i in _common(x, y)]


def _common(x: list[int], y: list[int]) -> list[int]:
    least = min(len(x), len(y))
    head = next((k for k in range(least) if x[k] != y[k]), least)
    tail = next((k for k in range(least - head) if x[-1 - k] != y[-1 - k]), least - head)
    start, stop = head, len(x) - tail
    x, y = x[head:stop], y[head : len(y) - tail]
    places = defaultdict(list)
    for j in range(len(y) - 1, -1, -1):
        places[y[j]].append(j)
    if sum(len(places.get(line, ())) for line in x) <= DENSE * (len(x) + len(y)):
        middle = _chained(x, places)
    else:
        half = len(x) // 2
        cut = int(np.argmax(_prefix_lengths(x[:half], y) + _prefix_lengths(x[half:][::-1], y[::-1])[::-1]))
        middle = [*_common(x[:half], y[:cut]), *(half + i for i in _common(x[half:], y[cut:]))]
    return [*range(head), *(start + i for i in middle), *range(stop, stop + tail)]


def difference(lines: list[str], own: list[int], partner: list[int] | None, other: list[int] | None = None) -> list[str]:
    """``lines`` without those that the partner shares; all of them if there is no partner or no line differs.

    A partner that shares more of what ``other``, the neighbour on the other side, lacks than it
    leaves to the page alone is a copy of the page; ``other`` decides then.
    """
    if not partner:
        return lines
    shared = set(common_lines(own, partner))
    if other:
        also = set(common_lines(own, other))
        if len(shared - also) > len(own) - len(shared):
            shared, partner = also, other
    if len(shared) == len(own) == len(partner):
        return lines
    return [x for k, x in enumerate(lines) if k not in shared]


def _hash(line: str) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(line) - (1 << 63)


def _split(url: str | None, at: int) -> tuple[str, str]:
    try:
        parts = urlsplit(url or "")
        if parts.hostname:
            return parts.hostname, parts.path
    except ValueError:
        pass
    return f"\0{at}", ""  # a page without a host has no partner


_LINED = "page_id long, url string, host string, path string, marked boolean, packed binary"
_CUT = f"part int, n long, text string, {_LINED}, path_before string, packed_before binary, path_after string, packed_after binary"
_SIDES = ("before", "after")


def _packed(page: Page) -> bytes:
    """Lines, each behind a + if it lies in a marked article, compressed; a line holds no line end."""
    return zlib.compress("\n".join("-+"[m] + x for x, m in page.lines).encode(), 1)


def _unpacked(packed: bytes) -> Page:
    text = zlib.decompress(packed).decode()
    return Page([(x[1:], x[0] == "+") for x in text.split("\n")] if text else [])


def _own_text(row: dict) -> str:
    """Text of a row that knows its neighbours (path, packed lines) on both sides; null: no neighbour of its host."""
    page = _unpacked(row["packed"])
    lines = page.text
    if not row["marked"]:
        start = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        hashes = lambda packed: [_hash(x) for x, _ in _unpacked(packed).lines]
        sides = [(start(row["path"], row[f"path_{s}"]), hashes(row[f"packed_{s}"])) for s in _SIDES if row[f"packed_{s}"]]
        sides = [x for x in sides if x[1]]
        lines = difference(lines, [_hash(x) for x, _ in page.lines], *([x[1] for x in sorted(sides, key=lambda x: -x[0])] or [None]))
    return " ".join(lines)


def _lined(rows: DataFrame) -> DataFrame:
    """Pages cut into lines."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for at, (i, url, source) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True)):
            page = parse(source)
            out.append((i, url, *_split(url, i or at), page.marked, _packed(page)))
        return _batch(out, _LINED)

    return map_batches(rows, cut, _LINED)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    named = [x.split(" ") for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _TYPES[t]) for k, (_, t) in enumerate(named)], names=[n for n, _ in named])


def _walked(lined: DataFrame, parts: int | None) -> DataFrame:
    """Rows of _CUT: each page with its text, or, at the ends of a range, with what is known of its neighbours instead.

    All pages are dealt by ranges of (host, path, page_id), so no host is one task; a task walks its
    range in order and holds three pages.
    """
    order = ["host", "path", "page_id", F.xxhash64("packed")]
    ranges = lined.repartitionByRange(parts, *order) if parts else lined.repartitionByRange(*order)
    names = [x.split(" ")[0] for x in _LINED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held, out, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close(before: dict | None, row: dict, after: dict | None) -> None:
            nonlocal n, size
            for s, x in zip(_SIDES, (before, after), strict=True):
                near = x is not None and x["host"] == row["host"]
                row |= {f"path_{s}": x["path"] if near else None, f"packed_{s}": x["packed"] if near else None}
            ends = before is None or after is None
            text = None if ends else _own_text(row)
            keep = names + [f"{c}_{s}" for s in _SIDES for c in ("path", "packed")]
            out.append((part, n, text, *(row[c] if ends or c in ("page_id", "url", "marked") else None for c in keep)))
            n += 1
            size += len(text or "") + 100

        for batch in batches:
            for row in batch.to_pylist():
                held.append(row)
                if len(held) == 2:
                    close(None, {**held[0]}, held[1])
                elif len(held) > 2:
                    close(held[-3], {**held[-2]}, held[-1])
                    del held[0]
                if size > 1 << 22:
                    yield _batch(out, _CUT)
                    out, size = [], 0
        if held:
            close(held[-2] if len(held) > 1 else None, {**held[-1]}, None)
        if out:
            yield _batch(out, _CUT)

    return ranges.sortWithinPartitions(*order).mapInArrow(run, _CUT)


def page_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", parts: int | None = None) -> DataFrame:
    """One row per page: page_id, url, text (its main text, lines joined by a blank), marked (whether the page marks its article).

    A null or empty page has an empty text. A null or broken URL has no partner, so only markup
    counts there; so has the single page of a host. Pages with the same URL may be partners; of pages
    whose lines are all alike nothing is deleted. ``parts``, the number of ranges that pages are dealt
    to, changes tasks, not results. Other columns aren't read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    walked = written(_walked(_lined(rows), parts), "walked")
    # two pages a range at most: their missing neighbours are the ends of the ranges beside
    edges = walked.where("text IS NULL").withColumn("k", F.row_number().over(Window.orderBy("part", "n")))
    for side, f in zip(_SIDES, (F.lag, F.lead), strict=True):
        near = f(F.struct("host", "path", "packed", "part")).over(Window.orderBy("k"))
        other = F.col("near.host").eqNullSafe(F.col("host")) & (F.col("near.part") != F.col("part"))
        edges = edges.withColumn("near", near).withColumns({f"{c}_{side}": F.when(other, F.col(f"near.{c}")).otherwise(F.col(f"{c}_{side}")) for c in ("path", "packed")}).drop("near")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _batch([(r["page_id"], r["url"], _own_text(r), r["marked"]) for r in batch.to_pylist()], "page_id long, url string, text string, marked boolean")

    done = walked.where("text IS NOT NULL").select("page_id", "url", "text", "marked")
    return done.unionByName(map_batches(edges, finish, "page_id long, url string, text string, marked boolean"))


def op1(spark, sf_dir: str) -> DataFrame:
    found = page_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "marked")


