"""Language identification: script ranges narrow the candidates of a word, letter models score it per
language, and Viterbi with a penalty for switching labels the spans of mixed-language text.

Scores are integers, so that the best path is exact. Long texts are cut into runs of words whose
best scores from every state to every state are combined (max-plus products): the path is that of the
whole text, with as many numpy steps as a run is long.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, texts

#: First and last code point of the scripts told apart. Fixed values of the Unicode standard, main blocks only.
SCRIPTS = (
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF), ("arabic", 0x0600, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
)
NAMES = ("other", *dict.fromkeys(s[0] for s in SCRIPTS))
#: Letters with a class of their own; others share one per script.
CLASSES, SCALE, CLIP, SWITCH, RUN = 64, 256, 12.0, 10.0, 128
#: Labelled documents that the model learns from, at most about so many per language.
TRAIN_DOCS = 2000
#: The tables of a model take 0.5 MB for each label: more labels than this are an error, not a smaller model.
MAX_LABELS = 512
#: Rows of a batch times the square of the labels, at most about so many (memory of the best paths).
BATCH = 1 << 18
UND = "und"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point below 0x20000: its lower case, whether it is a letter, its script."""
    n = 0x20000
    lower, letter, script = np.arange(n, dtype=np.uint32), np.zeros(n, bool), np.zeros(n, np.uint8)
    for c in range(n):
        x = chr(c)
        if x.isalpha():
            letter[c] = True
            y = x.lower()
            if len(y) == 1:
                lower[c] = ord(y)
    for name, first, last in SCRIPTS:
        script[first : last + 1] = NAMES.index(name)
    return lower, letter, script


def _codes(batch: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with a space after each, those below 0x20000; whether letters; where texts start."""
    code = np.frombuffer("".join(t + " " for t in batch).encode("utf-32-le"), np.uint32)
    code = np.where(code < 0x20000, code, np.where(code < 0x323B0, 0x4E00, 0x20)).astype(np.uint32)
    lower, letter, _ = _tables()
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in batch])])
    return lower[code], letter[code], starts


@dataclass
class LanguageModel:
    """Letter-class trigram scores. ``langs`` in order; ``scores[trigram, lang]``; ``scripts[script, lang]`` says who uses what."""

    langs: list[str]
    classes: np.ndarray
    scores: np.ndarray
    scripts: np.ndarray


def _trigrams(cls: np.ndarray) -> np.ndarray:
    """Of each place, the classes before it, two back first, with its own: no-letters are class 0."""
    two = np.concatenate([[0, 0], cls[:-2]]).astype(np.int64)
    one = np.concatenate([[0], cls[:-1]]).astype(np.int64)
    two[one == 0] = 0
    return (two * CLASSES + one) * CLASSES + cls


def _class_of(letters: list[int]) -> np.ndarray:
    """The class of each code point: 0 none; letters given have their own; the others one of their script's."""
    _, letter, script = _tables()
    shared = CLASSES - len(NAMES)
    out = np.where(letter, shared + script, 0).astype(np.uint8)
    for k, c in enumerate(letters[: shared - 1]):
        out[c] = k + 1
    return out


def training_rows(docs: DataFrame) -> DataFrame:
    """Documents to learn from: with a label, and not of the held-out third; a null id is not held out, and all rows of an id go one way."""
    return docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> LanguageModel:
    """Learn from text and lang of about ``train_docs`` documents per language, drawn by a hash of their row's place in the table.

    Null and repeated ids, and copies, are rows like others.

    Counting runs in Spark. The driver gets the documents of each label, the letters of each label and script,
    the most frequent letters (as many as have classes of their own) and trigram counts: all bounded by
    the labels, scripts and classes. Every label is learned; more than ``MAX_LABELS`` raise a ValueError.
    """
    rows = docs.select(F.col("lang").cast("string").alias("lang"), "text").where("lang is not null and text is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().limit(MAX_LABELS + 1).collect()}
    if len(counts) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} labels in lang")
    langs = sorted(counts)
    if not langs:
        return LanguageModel([], np.zeros(0x20000, np.uint8), np.zeros((CLASSES**3, 0), np.int16), np.zeros((len(NAMES), 0), bool))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(int(min(1.0, train_docs / n) * (1 << 30))))])
    placed = rows.select("lang", "text", F.monotonically_increasing_id().alias("place"))
    # Written once, so that letters and trigrams are counted over the same rows.
    drawn = materialize(placed.where(F.pmod(F.xxhash64("place"), F.lit(1 << 30)) < F.element_at(share, F.col("lang"))).select("lang", "text"))

    def letters(batch: pa.RecordBatch) -> pa.RecordBatch:
        return _counted(batch, langs, lambda code, letter: code[letter].astype(np.int64))

    # One row per letter and label, counted once: both sums below are over it.
    top = materialize(map_arrow(drawn.select("lang", "text"), letters, "lang int, item long, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")))
    script = F.lit(0)
    for name, first, last in reversed(SCRIPTS):
        script = F.when(F.col("item").between(first, last), NAMES.index(name)).otherwise(script)
    use = np.zeros((len(NAMES), len(langs)))
    for r in top.groupBy("lang", script.alias("script")).agg(F.sum("n").alias("n")).collect():
        use[r["script"], r["lang"]] = r["n"]
    own_class = top.groupBy("item").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "item").limit(CLASSES).collect()
    scripts = use > 0.001 * np.maximum(1, use.sum(0))
    classes = _class_of([r["item"] for r in own_class])

    def trigrams(batch: pa.RecordBatch) -> pa.RecordBatch:
        def items(code: np.ndarray, letter: np.ndarray) -> np.ndarray:
            cls = classes[code]
            return _trigrams(cls)[letter | np.concatenate([[False], letter[:-1]])]

        return _counted(batch, langs, items)

    got = map_arrow(drawn.select("lang", "text"), trigrams, "lang int, item long, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros((CLASSES**3, len(langs)))
    n[got["item"].to_numpy(np.int64), got["lang"].to_numpy(np.int64)] = got["n"]
    cube = n.reshape(CLASSES, CLASSES, CLASSES, len(langs))
    # P(class | two before), backed off to one before and to none.
    uni = (cube.sum((0, 1)) + 0.5) / (cube.sum((0, 1)) + 0.5).sum(0)
    bi = (cube.sum(0) + 5 * uni) / (cube.sum(0).sum(1, keepdims=True) + 5)
    tri = (cube + 5 * bi) / (cube.sum(2, keepdims=True) + 5)
    scores = np.clip(np.log(tri) * SCALE, -30000, 0).astype(np.int16).reshape(-1, len(langs))
    return LanguageModel(langs, classes, scores, scripts)


def _counted(batch: pa.RecordBatch, langs: list[str], items) -> pa.RecordBatch:
    """Counts of the items of a batch, by language."""
    lang, got = batch.column(0).to_pylist(), ([], [], [])
    all_texts = texts(batch.column(1))
    for k, name in enumerate(langs):
        own = [t for t, x in zip(all_texts, lang, strict=True) if x == name]
        if own:
            code, letter, _ = _codes(own)
            item, n = np.unique(items(code, letter), return_counts=True)
            for out, x in zip(got, (np.full(len(item), k), item, n), strict=True):
                out.append(x)
    item = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in got]
    return pa.RecordBatch.from_arrays([pa.array(item[0].astype(np.int32)), pa.array(item[1].astype(np.int64)), pa.array(item[2].astype(np.int64))], names=["lang", "item", "n"])


def word_scores(code: np.ndarray, letter: np.ndarray, model: LanguageModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and end place of each word, and its scaled score per language, at most 0 for the best."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8)))
    first, end = edge[::2], edge[1::2]
    if not len(first) or not model.langs:
        return first, end, np.zeros((len(first), len(model.langs)), np.int32)
    tri = _trigrams(model.classes[code])
    inside = np.zeros(len(code), bool)
    inside[letter] = True
    inside[end] = True  # the end of a word is part of it; a text ends with a space
    at = np.flatnonzero(inside)
    own = model.scores[tri[at]].astype(np.int32)
    starts = np.searchsorted(at, first)
    score = np.add.reduceat(own, starts, axis=0)
    usable = model.scripts[_tables()[2][code[first]]]
    none = ~usable.any(1)
    score[~usable] = -(1 << 30)
    score = np.maximum(score - score.max(1, keepdims=True), -int(CLIP * SCALE))
    score[none] = 0
    return first, end, score


def viterbi(score: np.ndarray, bounds: np.ndarray, penalty: int, run: int = RUN) -> np.ndarray:
    """The label of each word on the best path of its text; words of text t are bounds[t] to bounds[t + 1]."""
    n, langs = score.shape
    labels = np.zeros(n, np.int64)
    lengths = np.diff(bounds)
    docs = np.flatnonzero(lengths)
    if not len(docs) or langs == 0:
        return labels
    chunks = -(-lengths[docs] // run)
    chunk0 = np.concatenate([[0], np.cumsum(chunks)])
    c = int(chunk0[-1])
    # Words by run: where there is no word a score of 0 for all changes no path.
    doc_of = np.repeat(np.arange(len(docs)), lengths[docs])
    within = np.arange(n) - bounds[docs][doc_of]
    row, col = chunk0[doc_of] + within // run, within % run
    steps = np.zeros((run, c, langs), np.int32)
    steps[col, row] = score
    low = np.int32(-(1 << 29))
    best = np.full((c, langs, langs), low, np.int32)
    best[:, np.arange(langs), np.arange(langs)] = 0
    for t in range(run):
        best = np.maximum(best, best.max(2, keepdims=True) - penalty) + steps[t][:, None, :]
    # Before each run of a text: the best score of each state. Kept from growing by taking the largest away.
    before = np.zeros((c, langs), np.int32)
    state = np.zeros((len(docs), langs), np.int32)
    for j in range(int(chunks.max())):
        has = np.flatnonzero(chunks > j)
        at = chunk0[has] + j
        before[at] = state[has]
        after = (state[has][:, :, None] + best[at]).max(1)
        state[has] = after - after.max(1, keepdims=True)
    last, first = np.zeros(c, np.int64), np.zeros(c, np.int64)
    now = state.argmax(1)
    for j in range(int(chunks.max()) - 1, -1, -1):
        has = np.flatnonzero(chunks > j)
        at = chunk0[has] + j
        last[at] = now[has]
        first[at] = (before[at] + best[at, :, now[has]]).argmax(1)
        now[has] = first[at]
    # Within each run, from its known first state to its known last.
    value = np.full((c, langs), low, np.int32)
    value[np.arange(c), first] = 0
    back = np.zeros((run, c, langs), np.int16)
    own = np.arange(langs)
    for t in range(run):
        top = value.argmax(1)
        jump = value[np.arange(c), top][:, None] - penalty
        switch = jump > value
        back[t] = np.where(switch, top[:, None], own[None, :])
        value = np.where(switch, jump, value) + steps[t]
    path = np.zeros((run, c), np.int64)
    now = last
    for t in range(run - 1, -1, -1):
        path[t] = now
        now = back[t][np.arange(c), now]
    return path[col, row]


def _rows(model: LanguageModel) -> int:
    return max(8, min(256, BATCH // max(1, len(model.langs)) ** 2))


def identify(docs: DataFrame, model: LanguageModel, switch: float = SWITCH) -> DataFrame:
    """``doc_id, lang_pred, score, spans``: spans is an array of (start, end, lang) in code points.

    The language is that of the most letters on the best path, ties to the first in order; the score is
    its share of the letters. A null text, one without letters, or a model without languages gives
    ``und``, score 0 and no spans. Every row gives one row, repeated rows and null ids too; other
    columns are ignored. The model has a fixed size, whatever it was learned from.
    """
    penalty = round(switch * SCALE)

    def run(batch: pa.RecordBatch, model: LanguageModel) -> pa.RecordBatch:
        code, letter, starts = _codes(texts(batch.column(1)))
        first, end, score = word_scores(code, letter, model)
        n, langs = len(starts) - 1, len(model.langs)
        bounds = np.searchsorted(first, starts)
        label = viterbi(score, bounds, penalty)
        doc = np.repeat(np.arange(n), np.diff(bounds))
        weight = np.bincount(doc * max(1, langs) + label, weights=end - first, minlength=n * max(1, langs)).reshape(n, -1)
        total = weight.sum(1)
        known = (total > 0) & (langs > 0)
        pred = [model.langs[k] if ok else UND for k, ok in zip(weight.argmax(1), known, strict=True)]
        share = np.where(known, weight.max(1) / np.maximum(total, 1), 0.0)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])
        if langs == 0:
            new[:] = False
        at = np.flatnonzero(new)
        stop = np.concatenate([at[1:], [len(doc)]])[: len(at)] - 1
        names = pa.array(model.langs, pa.string()).take(pa.array(label[at])) if langs else pa.array([], pa.string())
        spans = pa.StructArray.from_arrays(
            [pa.array(first[at] - starts[doc[at]], pa.int64()), pa.array(end[stop] - starts[doc[at]], pa.int64()), names], ["start", "end", "lang"]
        )
        offsets = pa.array(np.searchsorted(doc[at], np.arange(n + 1)).astype(np.int32))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred), pa.array(share), pa.ListArray.from_arrays(offsets, spans)], names=["doc_id", "lang_pred", "score", "spans"])

    schema = "doc_id long, lang_pred string, score double, spans array<struct<start long, end long, lang string>>"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), partial(run, model=model), schema, _rows(model))


def keep_identified(docs: DataFrame, model: LanguageModel, min_share: float, switch: float = SWITCH) -> DataFrame:
    """The rows of ``docs`` whose main language has at least ``min_share`` of the letters; all columns stay as they are.

    A null or empty text, or one without letters, goes, and so do all rows where the model knows no language. Each row is
    judged by its text alone, repeated ones and those without id too; an empty table gives an empty one.
    """
    at, penalty = docs.columns.index("text"), round(switch * SCALE)

    def run(batch: pa.RecordBatch, model: LanguageModel) -> pa.RecordBatch:
        code, letter, starts = _codes(texts(batch.column(at)))
        first, end, score = word_scores(code, letter, model)
        bounds = np.searchsorted(first, starts)
        label = viterbi(score, bounds, penalty)
        n, langs = batch.num_rows, max(1, len(model.langs))
        doc = np.repeat(np.arange(n), np.diff(bounds))
        weight = np.bincount(doc * langs + label, weights=end - first, minlength=n * langs).reshape(n, langs)
        ok = (weight.max(1) >= min_share * weight.sum(1)) & (weight.sum(1) > 0) & (len(model.langs) > 0)
        return batch.filter(pa.array(ok))

    return map_arrow(docs, partial(run, model=model), docs.schema, _rows(model))
