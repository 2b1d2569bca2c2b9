"""Main text of web pages by nearest-URL page differencing.

Pages are sorted by host and URL path; each is compared with the nearest pages of its host that have
other lines. Lines are aligned by longest common subsequence, and aligned lines are deleted as
template text, except where both stand in an article: what two articles share is their own text. What
stays is the main text, in an article element or not; only a page without such a neighbour relies on that element.
Parts that HTML itself marks as not the main text (menus, footers, forms, scripts and so on) go first.
"""

from __future__ import annotations

import hashlib
import html
import pickle
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|\Z)|<[!?][^>]*(?:>|\Z)""", re.S)
#: Elements whose content is never text of the page.
RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "canvas"))
#: Elements that hold navigation, page furniture or forms.
FURNITURE = frozenset(("nav", "header", "footer", "aside", "form", "head", "select", "button", "menu", "dialog"))
#: Elements inside a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold the article.
MAIN = frozenset(("article", "main"))
#: Elements that hold the whole page or the article: a mark says how they look, not that they are furniture.
WHOLE = MAIN | {"html", "body"}
#: A whole word of class, id or role that marks a container as not the main text; longer words about these things, such as no-sidebar or social-history, don't.
_MARK = re.compile(
    r"(?:(?:bottom|cookie|left|main|page|post|right|site|top)[-_])?"
    r"(?:ads?|advert\w*|adsbygoogle|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|newsletter|subscribe|popup|modal|sidebar|side|nav|navbar|navigation|menu|breadcrumbs?|"
    r"footer|masthead|comments?|commentlist|respond|replies|disqus|share|sharing|social|related|recommended|widget|toolbar|search|login|signup|complementary|contentinfo|skip-link|pagination|pager)"
    r"(?:[-_](?:area|bar|banner|block|box|buttons?|container|form|links?|list|notice|section|slot|unit|wrap|wrapper))?|(?:page|site|top)[-_]header",
    re.I,
)
#: One attribute after another: names start after white space, a slash or a value; values are read whole.
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
#: Elements whose start ends an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p pre search section summary table ul xmp".split()
)
#: Elements within which a paragraph outside of them stays open.
_P, P_SCOPE = frozenset(("p",)), frozenset(("button", "caption", "html", "marquee", "table", "td", "th"))
#: Elements whose end tag may be left out: which open ones their start ends, and where the search for these stops.
_LISTS, _ROWS = frozenset(("ul", "ol", "menu", "dir", "dl", "table", "td", "th")), frozenset(("table", "html"))
IMPLIED = {
    "li": (frozenset(("li",)), _LISTS),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), _LISTS)),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), _ROWS | {"tr"})),
    "tr": (frozenset(("tr",)), _ROWS),
}
ARTICLE, BODY = 1, 0
#: Pairs of lines up to which an alignment keeps all its matching points.
CELLS = 1 << 16


def _marked(attributes: str, inline: bool = False) -> bool:
    """Whether an element is hidden or, if it is no inline one, a container of something else than the main text."""
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        if name == "hidden" or name == "aria-hidden" and value.strip().lower() == "true":
            return True
        if not inline and name in ("class", "id", "role") and any(map(_MARK.fullmatch, value.split())):
            return True
    return False


def page_lines(page: str) -> list[tuple[str, int]]:
    """The blocks of a page outside of furniture, in order, each with whether it stands in an article."""
    lines: list[tuple[str, int]] = []
    text: list[str] = []
    open_tags: list[tuple[str, bool, bool]] = []  # name, furniture, article
    hidden = article = at = 0

    def flush() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line and not hidden:
            lines.append((line, ARTICLE if article else BODY))

    def close(to: int) -> None:
        nonlocal hidden, article
        while len(open_tags) > to:
            _, was_hidden, was_article = open_tags.pop()
            hidden -= was_hidden
            article -= was_article

    def innermost(names: frozenset[str], stops: frozenset[str]) -> int | None:
        for k in range(len(open_tags) - 1, -1, -1):
            if open_tags[k][0] in names:
                return k
            if open_tags[k][0] in stops:
                return None
        return None

    while at < len(page):
        found = _TOKEN.search(page, at)
        if not found:
            text.append(page[at:])
            break
        text.append(page[at : found.start()])
        at = found.end()
        closing, name, attributes = found.group(1), found.group(2), found.group(3)
        if name is None:
            continue
        name = name.lower()
        if name in INLINE and not (attributes and _marked(attributes, inline=True)):
            if name == "br":
                text.append(" ")
            if not closing or not any(t[0] == name for t in open_tags):
                continue
        if closing:
            flush()
            k = innermost(frozenset((name,)), P_SCOPE if name == "p" else frozenset())
            if k is not None:
                close(k)
            continue
        flush()
        for rule in ((_P, P_SCOPE) if name in ENDS_P else None, IMPLIED.get(name)):
            k = innermost(*rule) if rule else None
            if k is not None:
                close(k)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in VOID:
            continue
        # The header of an article holds its headline.
        furniture = name in FURNITURE and not (name == "header" and article) or bool(attributes) and name not in WHOLE and _marked(attributes, name in INLINE)
        open_tags.append((name, furniture, name in MAIN))
        hidden += furniture
        article += name in MAIN
    flush()
    return lines


def aligned(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of positions of a longest common subsequence, in memory linear in the lines.

    Common ends are taken off; what is long is halved where the best scores of both halves meet.
    """
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    number: dict = {}
    left, right = (np.array([number.setdefault(x, len(number)) for x in y[first : len(y) - last]], np.int64) for y in (a, b))
    inner = [(first + i, first + j) for i, j in _common(left, right)]
    ends = [(len(a) - k, len(b) - k) for k in range(last, 0, -1)]
    return [*((i, i) for i in range(first)), *inner, *ends]


def _common(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    if len(a) * len(b) <= CELLS or len(a) < 2:
        return _matching_points(a.tolist(), b.tolist())
    half = len(a) // 2
    cut = int((_scores(a[:half], b) + _scores(a[half:][::-1], b[::-1])[::-1]).argmax())
    return [*_common(a[:half], b[:cut]), *((half + i, cut + j) for i, j in _common(a[half:], b[cut:]))]


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The longest common subsequence of ``a`` with each beginning of ``b``."""
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return row


def _matching_points(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    ends: list[int] = []
    points: list[tuple[int, int, int]] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            points.append((i, j, ends[k - 1] if k else -1))
            if k == len(tails):
                tails.append(j)
                ends.append(len(points) - 1)
            else:
                tails[k], ends[k] = j, len(points) - 1
    out = []
    p = ends[-1] if ends else -1
    while p >= 0:
        i, j, p = points[p]
        out.append((i, j))
    return out[::-1]


def main_text(lines: list[tuple[str, int]], others: list[list[tuple[str, int]]]) -> str:
    """The lines of a page that stay after differencing with ``others``, joined; without others, those of its article, if it has one."""
    keep = [True] * len(lines)
    for other in others:
        for i, j in aligned([t for t, _ in lines], [t for t, _ in other]):
            if lines[i][1] != ARTICLE or other[j][1] != ARTICLE:
                keep[i] = False
    if not others and any(z == ARTICLE for _, z in lines):
        keep = [z == ARTICLE for _, z in lines]
    return "\n".join(t for (t, _), k in zip(lines, keep, strict=True) if k)


_KEY = ("host", "path", "url", "page_id")
_KEYED = "host string, path string, url string, page_id long"
#: A run is some pages of a host that follow one another and have the same lines: (host, digest of the lines, key of one of them).
Run = tuple[str, bytes, tuple]


def _joined(lines: list[tuple[str, int]]) -> str:
    """Lines as one string; lines hold no white space but single spaces."""
    return "\n".join(f"{z}{t}" for t, z in lines)


def _digest(joined: str) -> bytes | None:
    """Of the lines of a page; none where it has no lines."""
    return hashlib.blake2b(joined.encode(), digest_size=16).digest() if joined else None


def _sortable(key: tuple) -> tuple:
    """A key as Spark sorts it: nulls first, strings by their bytes."""
    return tuple((x is not None, x.encode() if isinstance(x, str) else x or 0) for x in key)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            found = pa.array([_digest(_joined(page_lines(x or ""))) for x in some.column(4).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*some.columns[:4], found], names=[*_KEY, "digest"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted partition: its first key, its first two runs and its last two, the last one first."""
    start, first, last = None, [], []
    for batch in batches:
        for *key, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            start = start or tuple(key)
            if found is None or last and last[0][:2] == (key[0], found):
                continue
            last = [(key[0], found, tuple(key)), *last[:1]]
            if len(first) < 2:
                first.append(last[0])
    if start:
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([pickle.dumps((start, first, last))], pa.binary())], names=["part", "ends"])


def outer_neighbours(ends: list[tuple[list[Run], list[Run]]]) -> list[tuple[Run | None, Run | None]]:
    """Of each partition the run before its first run and the one after its last run, in other partitions of any distance.

    ``ends`` has the first two runs of each partition and the last two, the last one first.
    """

    def other(run: Run, near: list[Run]) -> Run | None:
        return next((x for x in near if x[0] == run[0] and x[1] != run[1]), None)

    def sweep(pairs: list[tuple[list[Run], list[Run]]]) -> list[Run | None]:
        near: list[Run] = []  # the two runs passed last, the nearest first
        out = []
        for entered, left in pairs:
            out.append(other(entered[0], near) if entered else None)
            if len(left) > 1:
                near = left
            elif left and not (near and near[0][:2] == left[0][:2]):
                near = [left[0], *near[:1]]
        return out

    before = sweep(ends)
    after = sweep([(last, first) for first, last in reversed(ends)])[::-1]
    return list(zip(before, after, strict=True))


_PLACED = f"part int, side int, {_KEYED}, lines string"


def _place(batches: Iterator[pa.RecordBatch], starts: list[tuple], wanted: dict[tuple, list[tuple[int, int, bytes]]]) -> Iterator[pa.RecordBatch]:
    """Lines of pages with the number of their partition; pages that others need as neighbours go there too, once a task."""
    sent = set()
    types = (pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = []
            for *key, page in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True):
                joined = _joined(page_lines(page or ""))
                rows.append((max(0, bisect_right(starts, _sortable(tuple(key))) - 1), 0, *key, joined))
                near = (tuple(key), _digest(joined)) if tuple(key) in wanted else None
                if near and near not in sent:
                    sent.add(near)
                    rows += [(part, side, *key, joined) for part, side, found in wanted[near[0]] if found == near[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "side", *_KEY, "lines"])


def _difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted pages: those of each run against the runs before and after it in the same partition and host."""
    rows: list[tuple] = []
    place, before, lines, own = None, None, None, []  # of the run at hand: partition and host, lines of the run before, its lines, its pages

    def done(after: str | None) -> None:
        if own:
            text = main_text(_split(lines), [_split(x) for x in (before, after) if x])
            rows.extend((page_id, url, text) for page_id, url in own)
            own.clear()

    def out() -> Iterator[pa.RecordBatch]:
        for at in range(0, len(rows), 256):
            some = rows[at : at + 256]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))], names=["page_id", "url", "text"])
        rows.clear()

    for batch in batches:
        for part, side, host, _, url, page_id, joined in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if not joined:
                rows.append((page_id, url, ""))
            else:
                if place != (part, host):
                    done(None)
                    place, before, lines = (part, host), None, joined
                elif joined != lines:
                    done(joined)
                    before, lines = lines, joined
                if side == 0:
                    own.append((page_id, url))
            if len(rows) >= 256:
                yield from out()
    done(None)
    yield from out()


def _split(joined: str) -> list[tuple[str, int]]:
    return [(x[1:], int(x[0])) for x in joined.split("\n")]


def extract(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """``page_id, url, text``: the main text of every page, blocks joined by a newline.

    Null or empty html gives an empty text; null ids and urls stay null (pages without a url have no
    neighbours but each other); repeated pages are not differenced with their own copies; other columns
    are ignored; an empty table gives an empty result. A page is compared with the nearest page on each
    side that has other lines, and any, in the URL order of its whole host, however many copies or empty
    pages lie between. Hosts of any size are cut into many partitions; the pages next to a cut go to both
    sides. The driver holds up to five keys and four digests per partition.
    """
    url = F.coalesce("url", F.lit(""))
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://|[?#].*$", "")
    keyed = pages.select(
        F.lower(F.substring_index(bare, "/", 1)).alias("host"),
        F.regexp_replace(bare, r"^[^/]*", "").alias("path"),
        F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id"),
        F.col("html").cast("string").alias("html"),
    )
    n = partitions or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digests = materialize(keyed.mapInArrow(_digests, f"{_KEYED}, digest binary"))
    found = digests.repartitionByRange(n, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(_ends, "part long, ends binary")
    ends = [pickle.loads(r["ends"]) for r in sorted(found.collect(), key=lambda r: r["part"])]
    wanted: dict[tuple, list[tuple[int, int, bytes]]] = {}
    for part, runs in enumerate(outer_neighbours([e[1:] for e in ends])):
        for side, run in zip((-1, 1), runs, strict=True):
            if run:
                wanted.setdefault(run[2], []).append((part, side, run[1]))
    place = partial(_place, starts=[_sortable(e[0]) for e in ends], wanted=wanted)
    placed = keyed.mapInArrow(place, _PLACED).repartitionById(n, F.col("part"))
    return placed.sortWithinPartitions("part", "side", *_KEY).mapInArrow(_difference, "page_id long, url string, text string")
