"""Quality by neighbours, ranked search and collocations, against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvartal.llm import collocations, quality, ranked_search

DOCS = "doc_id long, text string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(rng, n, vocabulary):
    return " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


# --- quality ---------------------------------------------------------------------------------------


def prose(rng, good):
    vocabulary = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(2, 7))) for _ in range(60)]
    text = words(rng, rng.randint(8, 60), vocabulary).capitalize()
    if good:
        return text
    return rng.choice([text.upper() + "!!", re.sub(" ", " | ", text), re.sub(r"(\w+)", r"\1 \1 \1", text), re.sub(" ", "$$$ ", text)])


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, i % 4 > 0), int(i % 4 > 0)) for i in range(800)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5001, ""), (None, "plain words"), (5001, "")], DOCS)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 1), (7777, 0), (3, None)], "doc_id long, quality int")
    return rows, docs, labels


def test_quality_on_held_out_rows(labelled):
    rows, docs, labels = labelled
    got = quality.quality(docs, labels).collect()
    assert len(got) == 804
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 800]
    assert len(held) > 100
    assert sum(r.predicted == (r.doc_id % 4 > 0) for r in held) / len(held) > 0.95
    known = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    (empty,) = {r.score for r in got if r.doc_id in (5000, 5001)}
    assert empty == pytest.approx(sum(r[2] for r in known) / len(known))


def test_quality_ignores_held_out_labels_and_other_columns(labelled):
    _, docs, labels = labelled
    scores = lambda d, x: {(r.doc_id, round(r.score, 5)) for r in quality.quality(d, x).collect()}
    flipped = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    wide = docs.withColumn("score", F.lit(1)).withColumn("quality", F.lit(0)).withColumn("held_out", F.lit("x")).withColumn("a.b", F.lit(1))
    assert scores(docs, labels) == scores(wide.repartition(3), flipped)


def test_quality_with_few_or_no_labels(spark, labelled, monkeypatch):
    _, docs, labels = labelled
    assert {r.score for r in quality.quality(docs, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality.quality(docs, labels.where("quality = 1")).collect()} == {1.0}
    assert quality.quality(docs.limit(0), labels).count() == 0
    monkeypatch.setattr(quality, "SAMPLE", {1: 7, 0: 5})
    drawn, counts = quality.drawn(docs.unionByName(docs), labels)
    assert drawn.groupBy("quality").count().orderBy("quality").collect() == [(0, 5), (1, 7)] and counts[1] > 400


def test_votes_are_those_of_all_products():
    rng = random.Random(2)
    texts = [prose(rng, rng.random() < 0.7).encode() for _ in range(120)]
    space, vectors = quality.fit(texts)
    labels = np.array([rng.randrange(2) for _ in texts])
    voters = quality.Voters(space, vectors, labels, np.ones(len(texts)))
    asked = [prose(rng, True).encode() for _ in range(700)]
    got, nearest = voters.scores(asked)
    for text, score, best in list(zip(asked, got, nearest))[::50]:
        cosines = [float(space.vectors([text])[0] @ v) for v in vectors]
        near = sorted(range(len(texts)), key=lambda i: -cosines[i])[: quality.NEIGHBOURS]
        votes = [max(cosines[i], 0) ** quality.SHARPNESS for i in near]
        assert score == pytest.approx(sum(v * labels[i] for v, i in zip(votes, near)) / sum(votes), abs=1e-4)
        assert best == pytest.approx(max(cosines), abs=1e-5)


def test_shapes_and_shares():
    assert quality.shapes("Ab, ÉÉ 12!! XYZ".encode()) == [b"Xx,", b"x", b"9!", b"X"]
    assert quality.shares(b"a a a a a".split()) == [b"same:8", b"again:5"]
    assert quality.shares(b"a b".split()) == []


# --- ranked search -----------------------------------------------------------------------------------


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def ranked(docs, items, top=10):
    parts = [(d, terms(t)) for d, t in docs]
    n_docs, n_all = sum(bool(w) for _, w in parts), sum(len(w) for _, w in parts)
    df = Counter(t for _, w in parts for t in set(w))
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = {}
    for i, wanted in asked.items():
        scored = []
        for d, w in parts:
            m, tf = 100 - 90 + (90 * len(w) * n_docs) // max(n_all, 1), Counter(w)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 8 * m))
                for t in wanted if tf[t]
            )
            if score > 0:
                scored.append((-score, d is None, d))
        out[i] = [(k, d, -s) for k, (s, _, d) in enumerate(sorted(scored)[:top], 1)]
    return {i: rows for i, rows in out.items() if rows}


@pytest.mark.parametrize("seed, shard, block", [(1, 2_000_000, 500_000), (2, 60, 500_000), (3, 1, 20)])
def test_search_is_exact(spark, seed, shard, block):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Été", "ÄB", "x9"]
    docs = [(i, words(rng, rng.choice([0, 1, 3, 20, 200]), rng.choices(vocabulary, k=rng.choice([4, 43])))) for i in range(150)]
    docs += [(i, docs[7][1]) for i in range(500, 540)]  # ties
    docs += [(900, None), (901, ""), (902, "?!"), (7, docs[7][1]), (None, docs[7][1])]
    items = [(i, words(rng, rng.choice([1, 5, 30]), vocabulary)) for i in range(12)]
    items += [(50, None), (51, ""), (52, "nowhere"), (1, "w3 w3"), (53, "w1 W1 w1")]
    got = {}
    found = ranked_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"), shard=shard, block=block)
    assert [t for _, t in found.dtypes] == ["bigint", "int", "bigint", "bigint"]
    for r in found.collect():
        got.setdefault(r.item_id, []).append((r.rank, r.doc_id, r.score))
    assert {i: sorted(rows) for i, rows in got.items()} == ranked(docs, items)


def test_search_stops_early_and_reads_on_in_ties():
    rng = np.random.default_rng(1)
    n, terms_ = 4000, 3
    tf = rng.integers(1, 60, (n, terms_)).astype(np.int32)
    tf[17] = 5000  # far ahead in all lists
    shard = ranked_search.Shard(
        np.full(n, 100), np.full(n, terms_), np.tile(np.arange(terms_, dtype=np.int32), n), tf.ravel(),
        np.full(terms_, 700), n, 100 * n,
    )
    docs, _ = shard.best(np.arange(terms_), 1)
    assert docs.tolist() == [17]
    looked = []
    original = np.unique
    try:
        np.unique = lambda x: looked.append(len(x)) or original(x)
        shard.best(np.arange(terms_), 1)
    finally:
        np.unique = original
    assert sum(looked) < n / 4
    same = ranked_search.Shard(
        np.full(50, 10), np.full(50, 1), np.zeros(50, np.int32), np.ones(50, np.int32), np.array([5]), 50, 500
    )
    assert len(same.best(np.array([0]), 3)[0]) == 50  # all tie


def test_search_of_empty_tables_and_odd_columns(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b")], DOCS)
    items = spark.createDataFrame([("x", "B")], "item_id string, text string")
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).collect() == []
    wide = docs.withColumn("n", F.lit("n")).withColumn("ids", F.lit(1)).withColumn("item_id", F.lit(3)).withColumn("a.b", F.lit(1))
    found = ranked_search.search(wide, items.withColumn("term", F.lit("z"))).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in found] == [("x", 1, 2), ("x", 2, 1)]


def test_search_of_a_very_long_text(spark):
    rng = random.Random(9)
    docs = [(1, words(rng, 300_000, [f"w{i}" for i in range(900)])), (2, "w1 w2"), (3, "w2")]
    items = [(1, "w1 w2 w3")]
    found = ranked_search.search(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["rank"], r.doc_id, r.score) for r in found.collect()) == ranked(docs, items)[1]


# --- collocations --------------------------------------------------------------------------------------


def mined(docs, least, top):
    """Every phrase counted, the contract word by word."""
    counts, totals = {}, Counter()
    for lang, text in docs:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    key = (lang, tuple(w[i : i + k]))
                    counts[key] = counts.get(key, 0) + 1
    chosen = {k: a for k, a in counts.items() if a >= least and len(k[1]) >= 2}
    inside = {}
    for (lang, w), a in chosen.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                key = (lang, w[i : i + k])
                inside[key] = max(inside.get(key, 0), a)
    out = {}
    for (lang, w), a in chosen.items():
        if 100 * inside.get((lang, w), 0) >= 100 * a:
            continue
        n = totals[lang]
        cuts = []
        for k in range(1, len(w)):
            l, r = counts[lang, w[:k]], counts[lang, w[k:]]
            cuts.append((1000 * a * n // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r, n))
    return {
        (lang, place, p.decode(), -a, l, r, n, -s)
        for lang, rows in out.items() for place, (s, a, p, l, r, n) in enumerate(sorted(rows)[:top], 1)
    }


def found_in(spark, docs, least, monkeypatch, top=2000, chunk=500_000, shared=500_000, **bounds):
    monkeypatch.setattr(collocations, "LEAST", least)
    for name, value in bounds.items():
        monkeypatch.setattr(collocations, name, value)
    frame = spark.createDataFrame(docs, "lang string, text string").repartition(3)
    return {tuple(r) for r in collocations.collocations(frame, top, chunk, shared).collect()}


def phrases(rng, n):
    """Words of very unlike frequency, with set phrases, copies and repeats of a word."""
    vocabulary = [f"w{i}" for i in range(25)]
    weights = [1 / (i + 1) for i in range(25)]
    fixed = ["new york city hall", "ex ante", "a b a b a", "no no no no no no", "Ça va été", "a\tb\x0bc\x1cd"]
    out = []
    for _ in range(n):
        text = " ".join(
            rng.choice(fixed) if rng.random() < 0.2 else rng.choices(vocabulary, weights)[0] + rng.choice(["", "", "", ".", ","])
            for _ in range(rng.randint(0, 30))
        )
        out.append((rng.choice(["en", "de", None]), text.upper() if rng.random() < 0.1 else text))
    return out + [out[0]] * 8 + [("en", None), (None, ""), ("xx", "one two"), ("en", "...")]


@pytest.mark.parametrize("seed, least, top, chunk, shared, bounds", [
    (1, 5, 2000, 500_000, 500_000, {}),
    (2, 4, 6, 50, 0, {"PART": 40, "WIDER": 8}),
    (3, 3, 25, 7, 1000, {"BATCH": 150, "HELD": 50}),
])
def test_collocations_are_exact(spark, monkeypatch, seed, least, top, chunk, shared, bounds):
    docs = phrases(random.Random(seed), 250)
    got = found_in(spark, docs, least, monkeypatch, top, chunk, shared, **bounds)
    assert got == mined(docs, least, top)
    assert {r[0] for r in got} == {"en", "de", "und"}


def test_growth_stops_at_the_last_score(spark, monkeypatch):
    """Frequent first words are never grown when rarer ones fill the list."""
    rng = random.Random(5)
    docs = [("en", " ".join(f"r{rng.randrange(40)} s{rng.randrange(3)}. the the." for _ in range(20))) for _ in range(200)]
    grown = []
    original = collocations.Search.grow
    monkeypatch.setattr(collocations.Search, "grow", lambda self, rows: grown.extend(rows["phrase"].to_pylist()) or original(self, rows))
    got = found_in(spark, docs, 5, monkeypatch, top=10, PART=8)
    assert got == mined(docs, 5, 10)
    assert "r1" in grown and "the" not in grown


def test_collocations_of_nothing_and_of_a_long_text(spark, monkeypatch):
    assert found_in(spark, [("en", "a b c")], 3, monkeypatch) == set()
    empty = spark.createDataFrame([], "lang string, text string, phrase string, f int")
    assert collocations.collocations(empty).count() == 0
    rng = random.Random(6)
    docs = [("en", words(rng, 60_000, ["x", "y", "z", "q"])), ("en", "x " * 30_000)]
    assert found_in(spark, docs, 100, monkeypatch, chunk=5000) == mined(docs, 100, 2000)


def test_scores_are_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**12, 3 * 10**14, 7 * 10**11, 9 * 10**11)], "a long, n long, l long, r long")
    a, n, l, r = 10**12, 3 * 10**14, 7 * 10**11, 9 * 10**11
    assert row.select(collocations.score("l", "r").alias("s")).first().s == 1000 * a * n // (l * r)
