"""Markdown blocks and chunks.

A scanner in Python tasks splits a document into top-level blocks; whole documents pass through
one fold that makes chunks. Offsets are code points; the chunks of a document make up its text again.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.batches import records, small_parts

TARGET, LEAST, MOST = 300, 100, 600
_WORD = re.compile(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]")
#: Ends at which a block may be cut: lines in any block; in running text sentence marks and white space too (no no-break spaces).
_LINE_ENDS = re.compile(r"\n")
_TEXT_ENDS = re.compile(r"[.!?。！？\n]|\r(?!\n)|[^\S\r\n\x85\xa0\u2007\u202f]")
RUNNING_TEXT = ("paragraph", "heading", "html", "other")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+")
_HEADING = re.compile(r"(#{1,6})(?= |$)")
_UNDERLINE = re.compile(r"(?:(=+)|-+) *$")
_BREAK = re.compile(r"(?:(?:\* *){3,}|(?:- *){3,}|(?:_ *){3,})$")
_FENCE = re.compile(r"(`{3,})[^`]*$|(~{3,})")
_ITEM = re.compile(r"(?:([-+*])|([0-9]{1,9})([.)]))(?= |$)")
_DEFINITION = re.compile(r""" {0,3}\[(?=[^\]]*\S)(?:[^\[\]\\]|\\.)+\]:\s*(?:<[^<>\n]*>|[^\s<]\S*)(?:(?=\s)[ \t]*+\n?[ \t]*+(?:"[^"]*"|'[^']*'|\([^()]*\))|)[ \t]*(?:\n|\Z)""")
_DASHES = re.compile(r" *:?-+:? *")
_CELL_END = re.compile(r"(?<!\\)\|")
# The element names that begin an HTML block of CommonMark's sixth kind.
_HTML_NAMES = (
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset "
    "h1 h2 h3 h4 h5 h6 head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul"
)
_ATTRIBUTES = r"""(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s"'=<>`]+|'[^']*'|"[^"]*"))?)*"""
#: How HTML blocks begin and what ends them; without an end it is a blank line. The last kind can't interrupt a paragraph.
_HTML = (
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{_HTML_NAMES.replace(' ', '|')})(?:\s|/?>|$)", re.I), None),
    (re.compile(rf"(?:<[A-Za-z][A-Za-z0-9-]*{_ATTRIBUTES}\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$"), None),
)
BLOCKS = "post_id long, version int, block_idx int, text string, type string, level int, path array<string>, start int, `end` int, strong boolean"
CHUNKS = "post_id long, version int, chunk_idx int, text string, token_count int, paths array<array<string>>, types array<string>, start int, `end` int"


_KEYS = [("post_id", pa.int64()), ("version", pa.int32())]
_SPAN = [("start", pa.int32()), ("end", pa.int32())]
_BLOCK_ROWS = pa.schema([*_KEYS, ("block_idx", pa.int32()), ("text", pa.string()), ("type", pa.string()), ("level", pa.int32()), ("path", pa.list_(pa.string())), *_SPAN, ("strong", pa.bool_())])
_CHUNK_ROWS = pa.schema([*_KEYS, ("chunk_idx", pa.int32()), ("text", pa.string()), ("token_count", pa.int32()), ("paths", pa.list_(pa.list_(pa.string()))), ("types", pa.list_(pa.string())), *_SPAN])
_CONTENT = ("post_id", "version", "content")


def count_tokens(text: str) -> int:
    """A deterministic estimate: words of ASCII letters and digits, and every other visible character."""
    return len(_WORD.findall(text))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9]+|[^\sA-Za-z0-9]"))


def _cells(line: str) -> int:
    """Cells of a table row."""
    row = line.strip(" ").removeprefix("|")
    ends = len(_CELL_END.findall(row))
    return ends if row.endswith("|") and not row.endswith("\\|") else ends + 1


def _rules_table(rest: str, head: str) -> bool:
    """Whether a line of dashes below ``head`` makes that one the head of a table."""
    if "|" not in head or rest.strip("|:- "):
        return False
    parts = rest.strip(" ").removeprefix("|").removesuffix("|").split("|")
    return all(map(_DASHES.fullmatch, parts)) and len(parts) >= _cells(head)


def _title(text: str) -> str:
    """A heading's text without the number signs that close it."""
    text = text.strip()
    open_end = text.rstrip("#")
    return open_end.rstrip() if not open_end or open_end.endswith(" ") else text


class _Scanner:
    """Reads lines into open containers (quotes, lists and their items) with one open leaf; keeps what begins outside of all containers.

    A line first meets the open containers, then may open others; what is left goes to a leaf. A line that
    no container claims and that opens nothing still continues an open paragraph.
    """

    def __init__(self) -> None:
        self.blocks: list[dict] = []
        self.open: list[list] = []  # ["quote"], ["list", kind of mark], ["item", width, whether still empty]
        self.leaf = ""  # paragraph, code, fence, html or table
        self.fence = ("", 0)
        self.html_end: re.Pattern | None = None
        self.lines: list[tuple[int, str]] = []  # of the open paragraph: start and text

    def add(self, kind: str, start: int, **more) -> None:
        """A block begins: it fills the item at hand, and is kept if it stands in no container."""
        if self.open and self.open[-1][0] == "list" and kind != "item":
            self.open.pop()
        if self.open and self.open[-1][0] == "item":
            self.open[-1][2] = False
        if not self.open and kind != "item":
            self.blocks.append({"type": kind, "start": start, **more})

    def end_leaf(self) -> None:
        """The open leaf ends; definitions of links at the start of an outer paragraph are blocks of their own."""
        if self.leaf == "paragraph" and not self.open and self.lines[0][1].lstrip(" ").startswith("["):
            text, at, starts = "\n".join(x for _, x in self.lines) + "\n", 0, []
            while m := _DEFINITION.match(text, at):
                starts.append(text.count("\n", 0, at))
                at = m.end()
            if starts:
                self.blocks.pop()
                self.blocks += [{"type": "other", "start": self.lines[k][0]} for k in starts]
                if at < len(text):
                    self.blocks.append({"type": "paragraph", "start": self.lines[text.count("\n", 0, at)][0]})
        self.leaf, self.lines = "", []

    def close(self, to: int) -> None:
        """Containers beyond the first ``to`` end, and the leaf with them."""
        self.end_leaf()
        del self.open[to:]

    def claimed(self, s: str) -> tuple[int, int]:
        """How many open containers claim the line, and where what is left of it begins."""
        at = 0
        for k, c in enumerate(self.open):
            rest = s[at:].lstrip(" ")
            indent = len(s) - at - len(rest)
            if c[0] == "quote":
                if indent > 3 or not rest.startswith(">"):
                    return k, at
                at += indent + 1
                at += s.startswith(" ", at)
            elif c[0] == "item":
                if not rest:
                    if c[2]:
                        return k, at
                    at = len(s)
                elif indent < c[1]:
                    return k, at
                else:
                    at += c[1]
        return len(self.open), at

    def goes_on(self, s: str) -> bool:
        """Whether a leaf whose containers all claim the line takes it whole."""
        rest = s.lstrip(" ")
        indent = len(s) - len(rest)
        if self.leaf == "fence":
            mark, n = self.fence
            if indent < 4 and rest.startswith(mark * n) and not rest.strip(" ").strip(mark):
                self.end_leaf()
            return True
        if self.leaf == "html" and (rest or self.html_end):
            if self.html_end and self.html_end.search(s):
                self.end_leaf()
            return True
        if self.leaf == "code" and (indent > 3 or not rest):
            return True
        if self.leaf == "table" and "|" in rest and rest.strip(" ") != "|":
            return True
        if self.leaf != "paragraph" or not rest:
            self.end_leaf()
        return False

    def read(self, line: str, start: int) -> None:
        s = line.rstrip("\r\n")
        s = s.expandtabs(4) if "\t" in s else s
        n, at = self.claimed(s)
        whole = n == len(self.open)
        if whole and self.leaf and self.goes_on(s[at:]):
            return
        lazy = not whole and self.leaf == "paragraph"
        if not whole and not lazy:
            self.close(n)
        began = False
        while True:
            rest = s[at:].lstrip(" ")
            indent = len(s) - at - len(rest)
            inside = self.leaf == "paragraph" and not lazy  # a paragraph that the line could continue as it stands
            if not rest:
                break
            if indent > 3:
                if self.leaf != "paragraph":
                    self.add("code", start)
                    self.leaf = "code"
                    return
                break
            found = self.start_of(rest, inside, lazy)
            if not found:
                break
            kind, m = found
            if kind == "table":
                self.table(start)
                return
            if kind == "underline":
                title = " ".join(" ".join(x for _, x in self.lines).split())
                if not self.open:
                    self.blocks[-1].update(type="heading", level=1 if m.group(1) else 2, title=title)
                self.leaf, self.lines = "", []
                return
            self.close(n) if lazy else self.end_leaf()
            lazy, began = False, True
            if kind == "quote":
                self.add("quote", start)
                self.open.append(["quote"])
                at += indent + 1
                at += s.startswith(" ", at)
            elif kind == "list":
                at = self.item(s, at, indent, m, start)
            else:
                self.leaf_block(kind, m, rest, start)
                return
            n = len(self.open)
        if lazy and rest:
            self.lines.append((start, rest))
        elif lazy:
            self.close(n)
        elif rest:
            if self.leaf != "paragraph":
                self.add("paragraph", start)
                self.leaf = "paragraph"
            self.lines.append((start, rest))
        elif not began:
            self.end_leaf() if self.leaf == "paragraph" else None

    def start_of(self, rest: str, inside: bool, lazy: bool) -> tuple[str, re.Match | None] | None:
        """What begins with a line, by the rules of what may interrupt a paragraph."""
        first = rest[0]
        if first not in "#*-_`~>+|<:=" and not first.isdigit():  # nothing begins otherwise
            return None
        if inside and _rules_table(rest, self.lines[-1][1]):
            return "table", None
        if first == ">":
            return "quote", None
        if first == "#" and (m := _HEADING.match(rest)):
            return "heading", m
        if first in "`~" and (m := _FENCE.match(rest)):
            return "fence", m
        if first == "<":
            for k, (begins, _) in enumerate(_HTML):
                if (k < 6 or not (inside or lazy)) and (m := begins.match(rest)):
                    return f"html{k}", m
        if inside and first in "=-" and (m := _UNDERLINE.match(rest)) and not self.all_definitions():
            return "underline", m
        if first in "*-_" and (m := _BREAK.match(rest)):
            return "break", m
        if (m := _ITEM.match(rest)) and not (inside and (not rest[m.end() :].strip(" ") or m.group(2) and int(m.group(2)) != 1)):
            return "list", m
        return None

    def all_definitions(self) -> bool:
        text, at = "\n".join(x for _, x in self.lines) + "\n", 0
        while m := _DEFINITION.match(text, at):
            at = m.end()
        return at == len(text)

    def table(self, start: int) -> None:
        """The last line of the open paragraph heads a table."""
        head = self.lines.pop()[0]
        if self.lines:
            self.end_leaf()
            self.add("table", head)
        elif not self.open:
            self.blocks[-1]["type"] = "table"
        self.leaf, self.lines = "table", []

    def item(self, s: str, at: int, indent: int, m: re.Match, start: int) -> int:
        """A list item begins, in the open list if its marks are of one kind; where its content begins."""
        kind = m.group(1) or m.group(3)
        if not (self.open and self.open[-1] == ["list", kind]):
            self.add("list", start)
            self.open.append(["list", kind])
        marks = indent + m.end()
        content = s[at + marks :]
        spaces = len(content) - len(content.lstrip(" "))
        spaces = 1 if spaces > 4 or spaces == len(content) else spaces
        self.open.append(["item", marks + spaces, not content.strip(" ")])
        return min(len(s), at + marks + spaces)

    def leaf_block(self, kind: str, m: re.Match, rest: str, start: int) -> None:
        if kind == "heading":
            self.add("heading", start, level=len(m.group(1)), title=_title(rest[m.end() :]))
        elif kind == "break":
            self.add("break", start)
        elif kind == "fence":
            self.add("code", start)
            mark = m.group(1) or m.group(2)
            self.leaf, self.fence = "fence", (mark[0], len(mark))
        else:
            self.add("html", start)
            self.html_end = _HTML[int(kind[4:])][1]
            self.leaf = "" if self.html_end and self.html_end.search(rest) else "html"


def scan(text: str) -> list[dict]:
    """Top-level blocks by CommonMark's rules, with GFM tables; spans are contiguous, lines end in LF, CRLF or CR alone.

    Blank lines belong to the block before, those at the start to the first one. A text of blank lines is
    one block of type other, as is each definition of a link.
    """
    scanner, at = _Scanner(), 0
    for line in _LINE.findall(text):
        scanner.read(line, at)
        at += len(line)
    scanner.close(0)
    found = scanner.blocks or ([{"type": "other", "start": 0}] if text else [])
    path: list[tuple[int, str]] = []
    blocks = []
    for i, b in enumerate(found):
        level = b.get("level", 0)
        if level:
            path = [p for p in path if p[0] < level] + [(level, b["title"])]
        start, end = b["start"] if i else 0, found[i + 1]["start"] if i + 1 < len(found) else len(text)
        strong = b["type"] == "break" or level == 1
        blocks.append({"type": b["type"], "level": level, "path": [p[1] for p in path], "start": start, "end": end, "strong": strong, "block_idx": i, "text": text[start:end]})
    return blocks


def markdown_blocks(contents: DataFrame) -> DataFrame:
    """One row per block of each content (post_id, version, content); null and empty contents have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch, batch.column("content")):
                rows = [{"post_id": r["post_id"], "version": r["version"], **b} for r in part.to_pylist() for b in scan(r["content"] or "")]
                yield from records(rows, _BLOCK_ROWS)

    return contents.select(*_CONTENT).mapInArrow(run, BLOCKS)


def split_text(text: str, kind: str = "paragraph", target: int = TARGET, most: int = MOST) -> list[str]:
    """Parts of a block of at most ``most`` tokens, each cut at the natural end nearest to where ``target`` tokens end.

    An end before that place counts if it lies at most half the way back, one after it if the part keeps
    within ``most``; equally near the later one is taken, and without any the part ends at that place. A
    token is never parted, nor CRLF, so tokens and ends are found once, however long the text.
    """
    starts = [m.start() for m in _WORD.finditer(text)]
    if len(starts) <= most:
        return [text] if text else []
    ends = [m.end() for m in (_TEXT_ENDS if kind in RUNNING_TEXT else _LINE_ENDS).finditer(text)]
    parts, at, done = [], 0, 0
    while len(starts) - done > most:
        # As many characters as fit: up to the next token.
        goal, limit = starts[done + target], starts[done + most]
        least = at + max(1, (goal - at) // 2)
        low, near, high = bisect_left(ends, least), bisect_left(ends, goal), bisect_right(ends, limit)
        later = ends[near] if near < high else None
        sooner = goal if later == goal else ends[near - 1] if near > low else None
        if later is None or sooner is not None and later - goal > goal - sooner:
            cut = goal if sooner is None else sooner
        else:
            cut = later
        parts.append(text[at:cut])
        at, done = cut, bisect_left(starts, cut, done)
    return [*parts, text[at:]] if at < len(text) else parts


def split_oversize(blocks: list[dict], target: int = TARGET, most: int = MOST) -> list[dict]:
    """Blocks of which those over ``most`` tokens are cut; only the first part keeps a strong boundary."""
    out = []
    for b in blocks:
        at = b["start"]
        for k, part in enumerate(split_text(b["text"], b["type"], target, most) or [b["text"]]):
            out.append({**b, "text": part, "start": at, "end": at + len(part), "strong": b["strong"] and k == 0})
            at += len(part)
    return out


def split_blocks(blocks: DataFrame, target: int = TARGET, most: int = MOST) -> DataFrame:
    """Rows of ``markdown_blocks`` of which those over ``most`` tokens are cut; parts keep their block_idx and differ in start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch, batch.column("text")):
                yield from records(split_oversize(part.to_pylist(), target, most), _BLOCK_ROWS)

    return blocks.select(*_BLOCK_ROWS.names).mapInArrow(run, BLOCKS)


def _related(a: list[str], b: list[str]) -> bool:
    """Whether one path begins the other, or both have one parent."""
    n = min(len(a), len(b))
    return a[:n] == b[:n] or bool(a) and len(a) == len(b) and a[:-1] == b[:-1]


def assemble(blocks: list[dict], target: int = TARGET, least: int = LEAST, most: int = MOST) -> list[dict]:
    """Chunks of one document's blocks."""
    units: list[list[dict]] = []
    for b in blocks:
        if units and len(units[-1]) == 1 and units[-1][0]["type"] == "paragraph" and b["type"] in ("list", "code", "quote"):
            units[-1].append(b)
        else:
            units.append([b])
    pieces = []
    for unit in units:
        whole = {**unit[0], "text": "".join(b["text"] for b in unit), "end": unit[-1]["end"], "types": [b["type"] for b in unit]}
        n = count_tokens(whole["text"])
        if n <= most:
            pieces.append({**whole, "n": n})
        else:
            pieces += [{**b, "types": [b["type"]], "n": count_tokens(b["text"])} for b in split_oversize(unit, target, most)]
    chunks: list[dict] = []
    for p in pieces:
        n = p["n"]
        last = chunks[-1] if chunks else None
        if last is None or p["strong"]:
            joins = False
        elif last["last_path"] == p["path"]:
            joins = last["tokens"] + n <= most
        else:
            joins = last["tokens"] < least and _related(last["last_path"], p["path"])
        if joins:
            one_word = bool(_WORD.fullmatch(last["text"][-1:] + p["text"][:1]))  # of letters or digits on both sides of the seam
            last["text"] += p["text"]
            last["tokens"] += n - one_word
            last["end"], last["last_path"] = p["end"], p["path"]
            last["paths"] += [p["path"]] * (p["path"] not in last["paths"])
            last["types"] += [t for t in p["types"] if t not in last["types"]]
        else:
            chunks.append({"text": p["text"], "tokens": n, "paths": [p["path"]], "last_path": p["path"], "types": list(dict.fromkeys(p["types"])), "start": p["start"], "end": p["end"]})
    return chunks


def assemble_chunks(contents: DataFrame, target: int = TARGET, least: int = LEAST, most: int = MOST) -> DataFrame:
    """One row per chunk of each content (post_id, version, content); a document is one row, so its fold needs no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch, batch.column("content")):
                rows = [
                    {**c, "post_id": r["post_id"], "version": r["version"], "chunk_idx": i, "token_count": c["tokens"]}
                    for r in part.to_pylist()
                    for i, c in enumerate(assemble(scan(r["content"] or ""), target, least, most))
                ]
                yield from records(rows, _CHUNK_ROWS)

    return contents.select(*_CONTENT).mapInArrow(run, CHUNKS)


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks with their search fields."""
    return (
        chunks.withColumn("chunk_id", F.concat_ws("#", F.col("post_id").cast("string"), F.col("chunk_idx").cast("string")))
        .withColumn("heading_paths", F.transform("paths", lambda p: F.array_join(p, " > "))).withColumn("block_types", F.col("types"))
    )


def new_chunks(chunks: DataFrame, existing: DataFrame) -> DataFrame:
    """Chunks of versions that are not stored yet."""
    return chunks.join(existing.select("post_id", "version").distinct(), ["post_id", "version"], "left_anti")


def chunk_stats(chunks: DataFrame, contents: DataFrame, least: int = LEAST) -> DataFrame:
    """Chunks and tokens of each document, how many are small, and whether the chunks make up the text again."""
    own = chunks.groupBy("post_id", "version").agg(
        F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.count_if(F.col("token_count") < least).alias("n_small"),
        F.sort_array(F.collect_list(F.struct("chunk_idx", "text"))).alias("_c"),
    )
    whole = F.array_join(F.transform("_c", lambda c: c["text"]), "")
    joined = contents.select("post_id", "version", "content").join(own, ["post_id", "version"], "left")
    return joined.select(
        "post_id", "version", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "tokens", "n_small")], (F.coalesce(whole, F.lit("")) == F.coalesce("content", F.lit(""))).alias("is_exact")
    )
