"""Quality rules, line first: failing lines go, then documents that lose too much text are rejected.

A line fails when it is mostly symbols, shouting punctuation, a short line without an end mark, mostly
words of navigation without one, or mainly known boilerplate. Base counts follow fixed definitions.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, texts

SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\x0b\x0c\r"
#: End marks of a sentence, as the last character of a line's last word.
END_MARKS = ".!?:;\"')]…”»。！？"
#: Boilerplate, in lower case.
BOILERPLATE = (
    "all rights reserved",
    "cookie policy",
    "accept cookies",
    "terms of service",
    "terms of use",
    "privacy policy",
    "enable javascript",
    "lorem ipsum",
    "click here",
    "sign up for our newsletter",
)
#: Words of navigation bars, in lower case.
NAVIGATION = (
    "about", "account", "archive", "back", "blog", "careers", "cart", "categories", "contact", "download", "events", "facebook", "faq", "forum", "gallery", "help", "home",
    "instagram", "jobs", "login", "logout", "menu", "news", "next", "pages", "previous", "products", "register", "search", "services", "shop", "signup", "sitemap", "support", "twitter", "youtube",
    "startseite", "kontakt", "impressum", "anmelden", "suche", "produkte", "hilfe", "accueil", "recherche", "connexion", "produits", "aide", "inicio", "contacto", "buscar", "productos", "ayuda", "tienda",
)
_NAVIGATION = frozenset(x.encode() for x in NAVIGATION)
_BOILERPLATE = re.compile("|".join(map(re.escape, BOILERPLATE)))
SHORT_LINE, MAX_LOST = 3, 50
#: A boilerplate phrase fails a line of up to so many words, or one of which phrases are at least a fourth of the words.
BOILERPLATE_LINE = 10
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def line_fails(line: bytes, n_words: int) -> bool:
    """Whether a line with ``n_words`` words fails; a line without words never does."""
    if n_words == 0:
        return False
    symbols = len(line) - len(line.translate(None, SYMBOLS))
    if 4 * symbols > n_words:
        return True
    if 4 * (line.count(b"!") + line.count(b"?")) > n_words and n_words > SHORT_LINE:
        return True
    text = line.strip(SPACE).decode()
    if n_words <= SHORT_LINE and text[-1] not in END_MARKS:
        return True
    if text[-1] not in END_MARKS and 5 * sum(w in _NAVIGATION for w in line.lower().split()) >= 3 * n_words:
        return True
    found = _BOILERPLATE.findall(text.lower())
    return bool(found) and (n_words <= BOILERPLATE_LINE or 4 * sum(len(x.split()) for x in found) >= n_words)


def _repeat_words(words: list[list[bytes]]) -> np.ndarray:
    """Per document the words in 5-word windows that are found twice or more in it."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.fromiter((hash(w) for ws in words for w in ws), np.int64, int(lengths.sum())).view(np.uint64)
    if len(flat) < 5:
        return np.zeros(len(words), np.int64)
    doc = np.repeat(np.arange(len(words)), lengths)
    n = len(flat) - 4
    mixed = doc[:n].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(5):
        h = flat[k : k + n] * _MULTIPLY[k]
        mixed = (mixed ^ (h ^ (h >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
    whole = doc[:n] == doc[4:]
    at = np.flatnonzero(whole)
    key = mixed[at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[1:] == key[:-1]
    repeated = at[order[same[1:] | same[:-1]]]
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + 5, -1)
    return np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=len(words))


def measure(batch: list[str]) -> tuple[dict[str, np.ndarray], list[str]]:
    """Counts and verdicts of some texts, and the texts without their failing lines."""
    out: dict[str, list] = {k: [] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "lost_chars")}
    words, cleaned = [], []
    for text in batch:
        raw = text.encode()
        own = raw.split()
        words.append(own)
        bare = len(raw) - len(raw.translate(None, SPACE))
        chars = len(text) - bare
        lines = raw.split(b"\n")
        counts = [len(x.split()) for x in lines]
        full = [x for x, n in zip(lines, counts, strict=True) if n]
        keep = [not line_fails(x, n) for x, n in zip(lines, counts, strict=True)]
        if all(keep):
            lost, clean = 0, text
        else:
            gone = b"".join(b"".join(x.split()) for x, k in zip(lines, keep, strict=True) if not k)
            lost = len(gone.decode())
            clean = b"\n".join(x for x, k in zip(lines, keep, strict=True) if k).decode()
        cleaned.append(clean)
        for k, v in (("n_words", len(own)), ("word_chars", chars), ("n_symbols", len(raw) - len(raw.translate(None, SYMBOLS))), ("n_dup_lines", len(full) - len(set(full))), ("lost_chars", lost)):
            out[k].append(v)
    got = {k: np.array(v, np.int64) for k, v in out.items()}
    got["n_repeat_words"] = _repeat_words(words)
    got["base_failed"] = (got["n_words"] < 10) | (100 * got["n_repeat_words"] > 20 * got["n_words"])
    got["kept"] = ~got["base_failed"] & (100 * got["lost_chars"] <= MAX_LOST * got["word_chars"])
    return got, cleaned


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars")


def assess(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id``, the counts, ``base_failed``, ``kept`` and ``clean_text`` (the text without failing lines).

    Null and empty texts have no words, so they fail; every row gives one row, repeated ones and null
    ids too; other columns are ignored. Whole texts are read, of any length.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got, clean = measure(texts(batch.column(1)))
        columns = [batch.column(0), *[pa.array(got[k]) for k in (*COUNTS, "base_failed", "kept")], pa.array(clean, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", *COUNTS, "base_failed", "kept", "clean_text"])

    schema = "doc_id long, " + ", ".join(f"{k} long" for k in COUNTS) + ", base_failed boolean, kept boolean, clean_text string"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)


def clean_documents(docs: DataFrame) -> DataFrame:
    """The kept documents with their failing lines removed; columns as given, ``n_chars`` counted anew."""
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = names.index("text")
        got, clean = measure(texts(batch.column(at)))
        columns = [pa.array(clean, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names=names).filter(pa.array(got["kept"]))

    out = map_arrow(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


#: DuckDB's form of the query. End marks, words of navigation and boilerplate are those above.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS k
      FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1))) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM g) WHERE c > 1),
n AS (SELECT doc_id, count(DISTINCT i + o) AS n_repeat_words FROM r, (VALUES (0), (1), (2), (3), (4)) AS v(o) GROUP BY doc_id),
l AS (SELECT doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS lw,
             length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS sym,
             length(regexp_replace(line, '[^!?]', '', 'g')) AS bang
      FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
f AS (SELECT doc_id, line, length(array_to_string(lw, '')) AS chars,
             4 * sym > len(lw) OR (4 * bang > len(lw) AND len(lw) > 3)
             OR (len(lw) <= 3 AND NOT regexp_matches(lw[len(lw)], '[.!?:;"'')\]…”»。！？]$'))
             OR (NOT regexp_matches(lw[len(lw)], '[.!?:;"'')\]…”»。！？]$') AND 5 * len(list_filter(lw, lambda w: lower(w) IN (NAVIGATION_WORDS))) >= 3 * len(lw))
             OR (len(bp) > 0 AND (len(lw) <= 10 OR 4 * len(regexp_extract_all(array_to_string(bp, ' '), '[^ ]+')) >= len(lw))) AS fails
      FROM (SELECT *, regexp_extract_all(lower(line), 'all rights reserved|cookie policy|accept cookies|terms of service|terms of use|privacy policy|enable javascript|lorem ipsum|click here|sign up for our newsletter') AS bp FROM l)
      WHERE len(lw) > 0),
a AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE fails), 0) AS lost FROM f GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
      FROM w LEFT JOIN a USING (doc_id) LEFT JOIN n USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= 50 * word_chars AS kept
FROM m
""".replace("NAVIGATION_WORDS", ", ".join(f"'{w}'" for w in NAVIGATION))
