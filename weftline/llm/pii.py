"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Base kinds (email, ip, card, phone) follow fixed definitions and always stay; the method adds
``iban`` (confirmed by mod-97) and ``secret`` (a quoted or assigned key whose name says so).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

KINDS = ("email", "ip", "card", "phone", "iban", "secret")
BASE = KINDS[:4]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match from inside a run of digits fails where the one from its start fails, so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
# The whole key, of any length: parts joined by dots or equals signs too, and padding; possessive, so linear.
_SECRET = re.compile(r"(?i)\b(?:token|secret|api[_-]?key|password|passwd)\b[ \t]{0,4}[=:][ \t]{0,4}[\"']?((?=[A-Za-z0-9+/_.=-]{16})[A-Za-z0-9+/_-]++(?:[.=]++[A-Za-z0-9+/_-]++)*+=*+)")
# Without these a text has no match of the slower patterns.
_DOTTED, _CODED = re.compile(r"\.[0-9]"), re.compile(r"[A-Z]{2}[0-9]{2}")
_NAMES, _FOLDED = ("token", "secret", "api", "passw"), re.compile("[\u0130\u0131\u017f\u212a]")  # letters that match i, s and k in any case
#: Words near a span that raise its score, by kind.
CONTEXT = {
    "email": ("mail", "contact", "write"),
    "ip": ("host", "server", "address", "ip"),
    "card": ("card", "visa", "credit", "pay"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "secret": ("token", "secret", "key", "password"),
}
#: The score of a confirmed span before its context is seen.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "secret": 0.6}
WINDOW, BONUS = 40, 0.15


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            free = found.end()
        at = text.find("@", max(free, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        bare = (p.lstrip("0") for p in m.group().split("."))
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in bare):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        code = m.group().replace(" ", "")
        if 15 <= len(code) <= 34 and mod97(code):
            yield m.span()


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score) of one text in code points, by kind as listed, then start."""
    found: list[tuple[str, int, int]] = []
    if "@" in text:
        found += [("email", *s) for s in _emails(text)]
    if _DOTTED.search(text):
        found += [("ip", *s) for s in _ips(text)]
    found += [("card", *s) for s in _cards(text)]
    if "+" in text:
        found += [("phone", *s) for s in _phones(text)]
    if _CODED.search(text):
        found += [("iban", *s) for s in _ibans(text)]
    low = text.lower()
    if any(name in low for name in _NAMES) or _FOLDED.search(text):
        found += [("secret", *m.span(1)) for m in _SECRET.finditer(text) if m.end(1) - m.start(1) >= 16]
    scored = []
    for kind, start, end in found:
        near = text[max(0, start - WINDOW) : start].lower() + " " + text[end : end + WINDOW].lower()
        hits = sum(word in near for word in CONTEXT[kind])
        scored.append((kind, start, end, round(min(1.0, PRIOR[kind] + BONUS * hits), 4)))
    return scored


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])


def detect(docs: DataFrame) -> DataFrame:
    """``doc_id, spans``: an array of (kind, start, end, score), code points, end exclusive.

    Every row gives one row, repeated ones too; a null or empty text gives no spans; a null doc_id
    stays null; other columns are ignored. Patterns take time linear in the text, however long.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [
            [{"kind": k, "start": s, "end": e, "score": v} for k, s, e, v in find_spans(t)]
            for t in texts(batch.column(1))
        ]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(rows, pa.list_(_SPAN))], names=["doc_id", "spans"]
        )

    schema = "doc_id long, spans array<struct<kind string, start long, end long, score double>>"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def digest(found: DataFrame) -> DataFrame:
    """The columns of the query from ``detect``'s spans; ``scores`` are those of the spans, in their order."""

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans):
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.array_join(F.transform("spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def redact_text(text: str, min_score: float = 0.5) -> str:
    """``text`` with a placeholder such as ``[EMAIL]`` for every span; overlapping spans make one."""
    spans = sorted((s, -e, k) for k, s, e, v in find_spans(text) if v >= min_score)
    out, at = [], 0
    for start, end, kind in spans:
        if -end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, -end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` counted anew; all rows and columns stay, null texts stay null."""
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = names.index("text")
        clean = pa.array([None if t is None else redact_text(t) for t in batch.column(at).to_pylist()], pa.string())
        columns = [clean if i == at else batch.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    out = map_arrow(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out
