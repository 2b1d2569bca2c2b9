"""Language ID, search, sharding, near-duplicates, packing and the pipeline against plain versions."""

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from weftline.llm import langid, neardup, packing, quality, queries, shards, topk
from weftline.llm.common import numbered, table
from weftline.llm.tokens import BYTE_PATTERN, ByteTokens

# ---- language


def test_viterbi_equals_a_plain_one():
    rng = np.random.default_rng(4)
    for _ in range(40):
        lengths = rng.integers(0, 60, 7)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        score = -rng.integers(0, 50, (int(bounds[-1]), 3)).astype(np.int32)
        got = langid.viterbi(score, bounds, 40, run=8)
        for a, b in pairwise(bounds):
            if a == b:
                continue
            value = score[a].astype(int)
            for t in range(a + 1, b):
                value = np.maximum(value, value.max() - 40) + score[t]
            own = got[a:b]
            assert score[np.arange(a, b), own].sum() - 40 * (own[1:] != own[:-1]).sum() == value.max()


def test_language_held_out_accuracy(spark, sf):
    got = queries.op1_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out and lang is not null")
    assert held.where("lang = lang_pred").count() >= 0.97 * held.count()
    for r in got.limit(50).collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1


def test_language_spans_and_odd_rows(spark, sf, odd_docs, no_docs):
    docs = table(spark, sf, "documents")
    model = langid.fit(langid.training_rows(docs))
    by = {r["lang"]: r["text"][:300] for r in docs.where("length(text) > 400").groupBy("lang").agg({"text": "max"}).withColumnRenamed("max(text)", "text").collect()}
    mixed = spark.createDataFrame([(1, by["de"] + "\n" + by["es"])], "doc_id long, text string")
    row = langid.identify(mixed, model).first()
    assert {"de", "es"} <= {s["lang"] for s in row["spans"]} and len(row["spans"]) <= 8
    got = {r["doc_id"]: r for r in langid.identify(odd_docs, model).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3, 9, 13))
    assert langid.identify(no_docs, model).count() == 0
    nothing = langid.fit(langid.training_rows(no_docs))
    assert {r["lang_pred"] for r in langid.identify(odd_docs, nothing).collect()} == {"und"}


def test_every_label_is_learned(spark):
    """A language with few documents among one with thousands of letters, and far more than 64 labels."""
    han = "".join(chr(0x4E00 + k) for k in range(5000))
    rows = [(i, "zh", han[k : k + 500]) for i, k in enumerate(range(0, 5000, 500))] + [(100 + i, "el", "αλφα βητα γαμμα δελτα") for i in range(3)]
    rows += [(200 + 3 * k + j, f"x{k:02}", " ".join(chr(97 + k % 26) * (2 + k // 26) + chr(97 + (k * 7 + j) % 26) for j in range(12))) for k in range(75) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(docs)
    assert len(model.langs) == 77
    greek = spark.createDataFrame([(1, "βητα δελτα"), (2, han[7:40])], "doc_id long, text string")
    assert [r["lang_pred"] for r in langid.identify(greek, model).orderBy("doc_id").collect()] == ["el", "zh"]
    # Null and repeated ids are rows like others: about as many are drawn as asked for, and never none.
    for doc_id in ("cast(null as long)", "7L", "id"):
        many = spark.range(3000).selectExpr(f"{doc_id} as doc_id", "'aa' as lang", "'abc abd' as text").union(spark.range(5).selectExpr(f"{doc_id} as doc_id", "'zz' as lang", "'xyz' as text"))
        learned = langid.fit(many, train_docs=100)
        said = langid.identify(spark.createDataFrame([(1, "abc"), (2, "xyz")], "doc_id long, text string"), learned)
        assert learned.langs == ["aa", "zz"] and [r["lang_pred"] for r in said.orderBy("doc_id").collect()] == ["aa", "zz"]
    with pytest.raises(ValueError, match="labels"):
        langid.fit(spark.range(600).selectExpr("id as doc_id", "cast(id as string) as lang", "'abc' as text"))


def plain_language(text, model, penalty):
    """One text by one best path over its words, score by score."""
    lower, letter, script = langid._tables()
    words, at = [], 0
    while at < len(text):
        end = at
        while end < len(text) and letter[ord(text[end])]:
            end += 1
        if end > at:
            words.append((at, end))
        at = max(end, at + 1)
    paths = []
    for a, b in words:
        cls = [0, 0, *(int(model.classes[lower[ord(c)]]) for c in text[a:b]), 0]
        score = [sum(int(model.scores[(cls[i - 2] * 64 + cls[i - 1]) * 64 + cls[i], k]) for i in range(2, len(cls))) for k in range(len(model.langs))]
        usable = model.scripts[script[lower[ord(text[a])]]]
        top = max((s for s, u in zip(score, usable, strict=True) if u), default=0)
        own = [max(s - top, -int(langid.CLIP * langid.SCALE)) if u else -int(langid.CLIP * langid.SCALE) for s, u in zip(score, usable, strict=True)] if any(usable) else [0] * len(score)
        best = max((p[0] for p in paths), default=0)
        lead = next((p for p in paths if p[0] == best), None)
        paths = [((paths[k] if paths and paths[k][0] >= best - penalty else (best - penalty, lead[1]) if lead else (0, [])), k) for k in range(len(score))]
        paths = [(p[0] + own[k], [*p[1], k]) for p, k in paths]
    total = sum(b - a for a, b in words)
    value = max((p[0] for p in paths), default=0)
    return value, total


def test_best_paths_of_texts_equal_plain_ones(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.fit(langid.training_rows(docs))
    penalty = round(langid.SWITCH * langid.SCALE)
    for r in docs.where("length(text) between 20 and 1500 and doc_id % 40 = 0").collect():
        code, letter, starts = langid._codes([r["text"]])
        first, end, score = langid.word_scores(code, letter, model)
        label = langid.viterbi(score, np.searchsorted(first, starts), penalty)
        value = int(score[np.arange(len(label)), label].sum()) - penalty * int((label[1:] != label[:-1]).sum())
        want, total = plain_language(r["text"], model, penalty)
        assert (value, int((end - first).sum())) == (want, total)
        got = langid.identify(docs.where(F.col("doc_id") == r["doc_id"]), model).first()
        weight = np.bincount(label, weights=end - first, minlength=len(model.langs))
        assert got["lang_pred"] == model.langs[int(weight.argmax())] and abs(got["score"] - weight.max() / total) < 1e-12


# ---- search


def plain_topk(rows, k):
    out = []
    for q, v in {(i, tuple(v)) for i, v in rows if i % 100 == 0}:
        score = [(-sum(x * y for x, y in zip(v, w, strict=False)), i) for i, w in rows if i != q]
        out += [(q, r + 1, i, int(-s)) for r, (s, i) in enumerate(sorted(score)[:k])]
    return sorted(out)


def test_topk_equals_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, [rnd.choice([-1.0, 0.0, 0.5, 0.001, -0.001]) for _ in range(6)], "x") for i in range(700)]
    rows += [(i, [0.5, 0.5], "x") for i in range(700, 1100)]
    bad = [(1200, None, "x"), (1300, [None, 1.0], "x"), (1400, [float("nan")], "x"), (1500, [float("inf")], "x"), (None, [1.0], "x")]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, score string")
    vectors = topk.usable(df)
    got = sorted(tuple(r) for r in topk.exact_topk(vectors, vectors.where("vec_id % 100 = 0"), 10).collect())
    ints = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, _ in rows]
    assert got == plain_topk(ints, 10)
    few = vectors.where("vec_id < 4")
    assert topk.exact_topk(few, few.where("vec_id = 0"), 10).count() == 3
    assert topk.exact_topk(vectors.limit(0), vectors.limit(0), 10).count() == 0


@pytest.mark.parametrize("sample", [4, 200])
def test_topk_with_a_sampled_bound_and_many_tiles(spark, monkeypatch, sample):
    """Small shards and groups; one id with very many rows, and a query id with two vectors."""
    for name, size in (("SHARD", 64), ("SMALL", 64), ("GROUP", 3), ("BLOCK", 8), ("SAMPLE", sample)):
        monkeypatch.setattr(topk, name, size)
    rng = np.random.default_rng(6)
    rows = [(i, rng.integers(-9, 9, 5).astype(float).tolist()) for i in range(600)] + [(700, [1.0, 2.0, 3.0, 4.0, 5.0])] * 300 + [(100, [2.0, -1.0, 0.0, 4.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = sorted(tuple(r) for r in topk.exact_topk(df, df.where("vec_id % 100 = 0"), 10).collect())
    want = []
    for q in {i for i, _ in rows if i % 100 == 0}:
        asked = {tuple(v) for i, v in rows if i == q}
        scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for v in asked for i, w in rows if i != q)
        want += [(q, r + 1, i, int(-s)) for r, (s, i) in enumerate(scores[:10])]
    assert got == sorted(want)


@pytest.mark.parametrize("sample", [4, 200])
def test_topk_tells_rows_of_one_id_apart(spark, monkeypatch, sample):
    """Numbered rows: a query leaves out its own row alone; rows of its id, equal ones too, rank each other."""
    for name, size in (("SHARD", 64), ("SMALL", 64), ("GROUP", 3), ("BLOCK", 8), ("SAMPLE", sample)):
        monkeypatch.setattr(topk, name, size)
    rng = np.random.default_rng(7)
    rows = [(i, rng.integers(-9, 9, 5).astype(float).tolist()) for i in range(300)]
    rows += [(100, [9.0, 9.0, 9.0, 9.0, 9.0])] * 2 + [(100, [2.0, -1.0, 0.0, 4.0, 4.0])] + [(200, rows[200][1])] * 15
    vectors, name = numbered(spark.createDataFrame(rows, "vec_id long, v array<double>"))
    assert name == topk.ROW
    got = sorted(tuple(r) for r in topk.exact_topk(vectors, vectors.where("vec_id % 100 = 0"), 10).collect())
    want = []
    for own, (q, v) in enumerate(rows):
        if q % 100 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i) for other, (i, w) in enumerate(rows) if other != own)
            want += [(q, r + 1, i, int(-s)) for r, (s, i) in enumerate(scores[:10])]
    assert got == sorted(want) and len(want) == 10 * (3 + 3 + 15)
    alone = vectors.where("vec_id = 7")
    assert topk.exact_topk(alone, alone, 10).count() == 0


def test_topk_prunes_blocks():
    rows = [(np.arange(b * 8, b * 8 + 8), np.full((8, 2), float(b))) for b in range(10)]
    best, ids = topk.search_tile(np.array([-1]), np.array([[1.0, 1.0]]), rows, 3)
    assert ids.tolist() == [[72, 73, 74]] and best.tolist() == [[18.0] * 3]


# ---- shards


@pytest.mark.parametrize("hot", [0, 600])
def test_shards_are_even_and_whole(spark, hot):
    rnd = random.Random(7)
    rows = [(i, "".join(rnd.choice("abcdé ") for _ in range(rnd.randrange(5, 400)))) for i in range(2000)] + [(5000 + i, "the same text in many rows " * 8) for i in range(hot)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = shards.assign_shards(df, 8).toPandas()
    assert sorted(got["doc_id"]) == sorted(i for i, _ in rows)
    want = {i: (len(t.encode()) + 16, zlib.crc32(t.encode())) for i, t in rows}
    assert all(want[i] == (s, c) for i, s, c in zip(got["doc_id"], got["size"], got["text_crc32"], strict=True))
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() <= 1.06 * sums.mean() and sums.min() >= 0.94 * sums.mean()
    spread = got[got["doc_id"] >= 5000].groupby("text_crc32")["shard"].nunique()
    assert not len(spread) or spread.max() <= 3


def test_shards_cut_equal_rows_anywhere(spark):
    """Rows that are equal in every column, and copies without ids, fill all shards evenly."""
    rnd = random.Random(8)
    rows = [(77, "one row, many times " * 6)] * 4000 + [(None, "no id " * 20)] * 1000 + [(i, "".join(rnd.choice("abc ") for _ in range(rnd.randrange(5, 200)))) for i in range(1000)]
    got = shards.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and len(sums) == 8 and sums.max() <= 1.05 * sums.mean() and sums.min() >= 0.95 * sums.mean()
    assert all(sorted(x["slot"]) == list(range(len(x))) for _, x in got.groupby("shard"))


def test_shards_balance_few_large_texts(spark, sf):
    got = queries.op5_shards(spark, sf).toPandas()
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 40 and sums.max() <= 1.06 * sums.mean() and sums.min() >= 0.94 * sums.mean()
    copies = got.groupby("text_crc32").agg(n=("shard", "size"), shards=("shard", "nunique"))
    assert (copies[copies["n"] > 1]["shards"] == 1).mean() > 0.9


def test_written_shards_hold_every_row(spark, tmp_path):
    rows = [(1, "a", "x"), (1, "a", "x"), (None, "b", "y"), (2, None, None), (None, None, None)]
    path = f"file://{tmp_path}/shards"
    shards.write_shards(spark.createDataFrame(rows, "doc_id long, text string, slot string"), path, 3)
    back = spark.read.parquet(path)
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter(r[:2] for r in rows)
    assert all(sorted(x["slot"]) == list(range(len(x))) for _, x in back.toPandas().groupby("shard"))


def test_shards_odd_rows(odd_docs, no_docs):
    got = shards.assign_shards(odd_docs, 4).toPandas()
    assert len(got) == odd_docs.count() and got[got["doc_id"] == 1]["size"].tolist() == [16]
    assert all(sorted(x["slot"]) == list(range(len(x))) for _, x in got.groupby("shard"))
    assert shards.assign_shards(no_docs, 4).count() == 0


# ---- near-duplicates


def plain_components(rows, words, percent):
    sets = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append((i, {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())))
    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            where[x].append(k)
    common = Counter()
    for own in where.values():
        common.update((a, b) for n, a in enumerate(own) for b in own[n + 1 :])
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a][1]) + len(sets[b][1]) - n):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return {i: (len(s), least[find(k)]) for k, (i, s) in enumerate(sets)}


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, sf, words, percent):
    docs = table(spark, sf, "documents")
    want = plain_components([(r["doc_id"], r["text"]) for r in docs.collect()], words, percent)
    got = neardup.near_duplicates(docs, words, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("tile", [2048, 16])
def test_near_duplicates_of_large_groups(spark, monkeypatch, tile):
    """Groups of many near copies, of which not all are linked with one another, in whole tiles and in blocks."""
    monkeypatch.setattr(neardup, "TILE_DOCS", tile)
    rnd = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = []
    for g in range(3):
        base = [rnd.choice(vocabulary) for _ in range(80)]
        for _ in range(150):
            own = list(base)
            for _ in range(rnd.randrange(0, 5)):
                own[rnd.randrange(len(own))] = rnd.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
        shared = " ".join(base)
        rows += [(len(rows) + k, shared + " " + " ".join(rnd.choice(vocabulary) for _ in range(40))) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, 3, 85).collect()}
    assert got == plain_components(rows, 3, 85)


def test_near_duplicates_odd_rows(odd_docs, no_docs):
    got = neardup.near_duplicates(odd_docs, 3, 85).collect()
    assert len(got) == odd_docs.count()
    by = {r["doc_id"]: r for r in got}
    assert by[7]["component_id"] == 6 and not by[7]["kept"] and by[6]["kept"] and by[1]["n_shingles"] == 0 and by[4]["n_shingles"] == 1
    assert neardup.near_duplicates(no_docs, 3, 85).count() == 0


def test_near_duplicates_without_ids_and_with_repeated_ones(spark):
    """Rows are told apart by their place, not by doc_id."""
    base = [f"w{i}" for i in range(100)]
    near = [" ".join([*base[:k], "other", *base[k + 1 :]]) for k in (5, 50, 95)]
    alone = " ".join(f"v{i}" for i in range(30))
    rows = [(7, near[0]), (None, near[1]), (None, near[1]), (None, alone), (None, alone), (3, "x y z"), (3, "p q r s t"), (9, near[2]), (9, near[2]), (4, None), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.near_duplicates(df, 3, 85).collect()
    assert len(got) == len(rows)
    by = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got)
    assert by == Counter({(7, 98, 7, True): 1, (None, 98, 7, False): 2, (9, 98, 7, False): 2, (None, 28, None, True): 1, (None, 28, None, False): 1, (3, 1, 3, True): 1, (3, 3, 3, True): 1, (4, 0, 4, True): 1, (None, 0, None, True): 2})
    kept = neardup.one_of_each(df.withColumn("component", F.lit("x")).withColumn("_Row", F.lit("y")), 3, 85)
    assert kept.columns == ["doc_id", "text", "component", "_Row"] and {r["_Row"] for r in kept.collect()} == {"y"}
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(7, near[0]), (None, alone), (3, "x y z"), (3, "p q r s t"), (4, None), (None, ""), (None, None)])


def test_components_of_a_long_chain(spark):
    links = spark.range(1, 400).selectExpr("id as a", "id - 1 as b").union(spark.createDataFrame([(1000, 1001), (1001, 1000)], "a long, b long"))
    got = {r["node"]: r["component"] for r in neardup.components(links).collect()}
    assert got == dict.fromkeys(range(400), 0) | {1000: 1000, 1001: 1000}


# ---- packing


def test_byte_ids_equal_the_library(spark, sf):
    from tokenizers import Tokenizer

    assert public_tokenizers.PATTERN == BYTE_PATTERN
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    own = ByteTokens(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rnd = random.Random(13)
    made = ["".join(rnd.choice("  ab's've'll\n\n\t\xa0 \x85\x1c1é你🙂_-") for _ in range(rnd.randrange(50))) for _ in range(3000)]
    batch = [*made, "", "<|endoftext|>", *[r["text"] or "" for r in table(spark, sf, "documents").select("text").collect()]]
    flat, counts = own.encode_batch(batch)
    at = 0
    for want, text, n in zip(library.encode_batch(batch, add_special_tokens=False), batch, counts, strict=True):
        assert flat[at : at + n].tolist() == want.ids, repr(text[:60])
        at += n


def test_packed_ids_equal_the_library_with_its_added_token(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    made = [end, f"{end}start", f"the end {end}", f"in the {end} middle", f"a  {end}  b\n{end}{end}\n", f"<|{end}|>", "<|endoftext", f" {end}'s {end[:-1]} >", f"é{end}你" * 300]
    df = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    got = packing.pack(df, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    want = {}
    for i, text in enumerate(made):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want |= {(i, k): (a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())) for k, (a, n) in enumerate(packing.cut(len(ids)))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want


def test_packing_is_whole_and_tight(spark, sf):
    from tokenizers import Tokenizer

    got = queries.op9_packing(spark, sf).toPandas()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for r in table(spark, sf, "documents").collect():
        ids = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        for k, (a, b) in enumerate(pairwise(cuts)):
            want[r["doc_id"], k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist() and own["length"].sum() <= 1024
    assert got["sequence_id"].nunique() <= 1.01 * np.ceil(got["length"].sum() / 1024) + 1


def test_packing_odd_rows(odd_docs, no_docs):
    got = packing.pack(odd_docs.repartition(5), public_tokenizers.path("byte_bpe_50k.tiktoken")).toPandas()
    assert (got["piece"] == 0).sum() == odd_docs.count()
    assert got[got["doc_id"] == 1]["length"].tolist() == [1]
    assert packing.pack(no_docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).count() == 0


def test_packing_hands_on_a_bounded_number(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").repartition(6)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    whole, few = (packing.pack(docs, path, most=n).toPandas() for n in (packing.OPEN, 1))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(whole[columns].itertuples(index=False, name=None)) == sorted(few[columns].itertuples(index=False, name=None))
    assert few.groupby("sequence_id")["length"].sum().max() <= 1024 and not few.duplicated(["sequence_id", "offset"]).any()


def test_packing_fills_rooms_of_far_partitions(spark):
    """Partitions of one source each, with many more underfull sequences than a task takes."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = [(i, " word" * (600 if i < 600 else 400)) for i in range(1200)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "doc_id long, text string")
    got = packing.pack(df, path, most=64).toPandas()
    assert sorted(got["doc_id"]) == list(range(1200))
    assert not got.duplicated(["sequence_id", "offset"]).any() and got.groupby("sequence_id")["length"].sum().max() <= 1024
    assert got["sequence_id"].nunique() <= 1.03 * 600


def test_underfull_sequences_are_items():
    """Two underfull sequences of 500 and 524 become one; taken apart, their pieces are items of their own."""
    doc = lambda i, n: {"doc_id": i, "piece": 0, "start": 0, "length": n, "ids_crc32": 0}
    bins = [[doc(1, 300), doc(2, 200)], [doc(3, 500), doc(4, 24)], [doc(5, 700)]]
    batch = pa.RecordBatch.from_arrays([pa.array([0, 1, 2]), pa.array([500, 524, 700]), pa.array([True] * 3), pa.array(bins, pa.list_(packing._PIECE))], schema=packing._BINS)
    whole = [r for b in packing._pack_bins(iter([batch]), 1, 1024, 1016, False) for r in b.to_pylist()]
    assert sorted((r["size"], r["open"], [m["doc_id"] for m in r["members"]]) for r in whole) == [(700, True, [5]), (1024, False, [3, 4, 1, 2])]
    apart = [r for b in packing._pack_bins(iter([batch]), 1, 1024, 1016, True) for r in b.to_pylist()]
    assert sorted((r["size"], [m["doc_id"] for m in r["members"]]) for r in apart) == [(700, [3, 2]), (1024, [5, 1, 4])]


def test_best_fit():
    rnd = random.Random(1)
    sizes = [rnd.randrange(1, 1025) for _ in range(3000)]
    bins = packing.best_fit(sizes)
    assert sorted(i for b in bins for i in b) == list(range(3000)) and max(sum(sizes[i] for i in b) for b in bins) <= 1024
    assert len(bins) <= 1.02 * -(-sum(sizes) // 1024)


# ---- pipeline


def test_pipeline_stages(spark, sf, odd_docs):
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        if name != "packing":
            assert docs.columns == before.columns
            rows = docs.collect()
            docs = spark.createDataFrame(rows, before.schema)
            assert 0 < len(rows) <= before.count() and all(r["n_chars"] == len(r["text"]) for r in rows)
        if name == "near_duplicates":
            found = plain_components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
            assert {r["doc_id"] for r in rows} == {c for _, c in found.values()}
        if name == "pii":
            assert len(rows) == before.count() and not any(re.search(r"[a-z0-9]@mail\d", r["text"]) for r in rows)
    assert docs.count() > 0


def test_pipeline_stages_on_odd_rows(spark, sf, odd_docs):
    odd = odd_docs.select(*corpus_pipeline.COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in stages.items():
        assert stage(spark, odd.limit(0), sf).count() == 0, name
    # Each row is judged by its text alone.
    judged = {r["doc_id"]: r["kept"] for r in quality.assess(odd).where("doc_id is not null").collect()}
    kept = stages["quality"](spark, odd, sf).collect()
    assert {r["doc_id"] for r in kept} == {i for i, k in judged.items() if k} and len(kept) == len({r["doc_id"] for r in kept})
    known = stages["language"](spark, odd, sf).collect()
    assert not {1, 2, 3, 9, 13} & {r["doc_id"] for r in known} and sum(r["doc_id"] == 6 for r in known) == 2
    assert stages["language"](spark, odd.withColumn("lang", F.lit(None).cast("string")), sf).count() == 0
    copies = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (None, ""), (4, "x")]
    df = spark.createDataFrame([(i, t, None, None, len(t or "")) for i, t in copies], odd.schema)
    assert Counter((r["doc_id"], r["text"]) for r in stages["near_duplicates"](spark, df, sf).collect()) == Counter([(1, "a b c d e f g"), (3, None), (None, ""), (4, "x")])
    clean = stages["pii"](spark, odd, sf).collect()
    assert len(clean) == odd.count() and sum(r["text"] is None for r in clean) == odd.where("text is null").count() and not any("a@b.c" in (r["text"] or "") for r in clean)
    packed = stages["packing"](spark, odd, sf)
    assert packed.where("piece = 0").count() == odd.count()


def test_near_duplicates_move_buckets_once_and_signatures_not(spark, monkeypatch, sf):
    """Classes are put together without their signatures, and the rows of buckets are shuffled once, however large the tables are."""
    plans, write = [], neardup.materialize

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(neardup, "materialize", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        neardup.near_duplicates(table(spark, sf, "documents"), 3, 85)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum(p.count("Exchange hashpartitioning(bucket#") for p in plans if "explode(buckets" in p) == 1
    assert not any("Exchange hashpartitioning(set_key#" in p and "signature" in p for p in plans)


def test_near_duplicates_leave_texts_where_they_are(spark, sf):
    """Rows are picked by bitmaps of their numbers, which are small where lists of numbers aren't; columns may have any names."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(1).alias("_bits"), F.lit(2).alias("_BUCKET"), F.lit(3).alias("_number"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    want = sorted(r["doc_id"] for r in neardup.one_of_each(docs).select("doc_id").collect())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", 6000)
    try:
        got = neardup.one_of_each(docs)
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["doc_id"] for r in got.select("doc_id").collect()) == want and got.columns == docs.columns
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    numbers = [0, 7, 8, 32767, 32768, 32769, (5 << 33) - 1, 5 << 33, (5 << 33) + 1, (5 << 33) + 40000]
    rows = spark.createDataFrame([(n, str(n)) for n in numbers], "n long, text string")
    some = spark.createDataFrame([(n,) for n in numbers[::2] * 3], "k long")
    assert sorted(r["n"] for r in neardup._among(rows, some, "n", "k").collect()) == numbers[::2]
