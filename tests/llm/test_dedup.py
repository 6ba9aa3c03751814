"""Exact, near and passage dedup against brute force."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from kvartal.llm import components, exact_dedup, simhash, suffix_dedup

DOCS = "doc_id long, text string"
ODD = "doc_id long, text string, kept string, _part int, keep_id int, DOC int, rank int, `a.b` int"


def words(rng, n):
    return " ".join(rng.choice("abcdefgh") + rng.choice("klmnop") + rng.choice("xyz") * rng.randint(0, 3) for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(1, 300)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(40, 60):
        text = rng.choice(base).split()
        text[rng.randrange(len(text))] = "zz"
        rows.append((i, " ".join(text)))
    rows += [(i, base[3].upper().replace(" ", "\n\t ")) for i in range(60, 80)]
    rows += [(80, None), (81, ""), (82, " \t"), (None, base[3]), (None, None), (7, base[7]), (83, "é" * 2500)]
    rng.shuffle(rows)
    return rows


def same_text(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups_match_brute_force(spark):
    rows = corpus() + [(i, "copy  of one") for i in range(1000, 1400)]
    groups = collections.defaultdict(list)
    for d, t in rows:
        groups[same_text(t)].append(d)
    got = exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS).repartition(7)).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert (r.keep_id, r.group_size) == (min(known) if known else None, len(ids))
    kept = collections.Counter(r.text_sha256 for r in got if r.kept)
    assert kept == dict.fromkeys(by_sha, 1)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_group_across_partitions(spark):
    rows = [(i, "same") for i in range(500)] + [(i, f"t{i}") for i in range(500, 520)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = exact_dedup.exact_groups(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert {(r.keep_id, r.group_size) for r in got if r.doc_id < 500} == {(0, 500)}
    assert sorted(r.doc_id for r in got if r.kept) == [0, *range(500, 520)]


@pytest.mark.parametrize("drop", [exact_dedup.drop_exact, simhash.drop_near])
def test_stages_keep_all_columns(spark, drop):
    rows = [(1, "some words here to see", "a", 1, 2, 3, 4, 5), (2, "some words here to see", "b", 1, 2, 3, 4, 5), (3, None, None, None, None, None, None, None)]
    got = drop(spark.createDataFrame(rows, ODD))
    assert got.columns == ["doc_id", "text", "kept", "_part", "keep_id", "DOC", "rank", "a.b"]
    assert sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


@pytest.mark.parametrize(
    "operator",
    [exact_dedup.exact_groups, exact_dedup.drop_exact, simhash.near_duplicates, simhash.drop_near, suffix_dedup.remove_repeated],
)
def test_empty_tables(spark, operator):
    assert operator(spark.createDataFrame([], DOCS)).count() == 0


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@given(st.text(alphabet="aAbB éß\t\n ", max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_print(text)


def near_classes(rows):
    prints = [brute_print(t) for _, t in rows]
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                label[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in members.items()}
    return sorted(((rows[i][0], f"{prints[i]:016x}", least[find(i)]) for i in range(len(rows))), key=repr)


def test_near_duplicates_match_brute_force(spark):
    rows = corpus(2)
    got = simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=repr) == near_classes(rows)


def test_hot_cluster_is_linked_like_all_pairs(spark):
    rng = random.Random(5)
    centre, codes = rng.getrandbits(64), set()
    while len(codes) < 1500:
        code = centre
        for _ in range(rng.randint(0, 9)):
            code ^= 1 << rng.randrange(64)
        codes.add(code)
    codes = np.array(sorted(codes), "u8")
    a, b = np.nonzero(np.triu(np.bitwise_count(codes[:, None] ^ codes[None]) <= 4, 1))
    want = components.roots(len(codes), a, b)
    prints = spark.createDataFrame([(int(c),) for c in codes.view("i8")], "_print long")
    edges = simhash.fingerprint_links(prints.repartition(9)).toPandas()
    place = {int(c): i for i, c in enumerate(codes.view("i8"))}
    got = components.roots(len(codes), edges["a"].map(place).to_numpy(), edges["b"].map(place).to_numpy())
    assert np.array_equal(got, want)
    assert len(edges) < 40 * len(codes)


def test_trees_cut_from_one_partition_are_linked(monkeypatch):
    monkeypatch.setattr(simhash, "TREE_ROWS", 64)
    rng = np.random.default_rng(3)
    codes = np.sort(rng.integers(0, 1 << 9, 300, dtype=np.uint64))
    codes = np.unique(codes)
    batch = lambda x: pa.RecordBatch.from_arrays([pa.array(np.zeros(len(x), "i8")), pa.array(x.view("i8")), pa.array(np.full(len(x), 2, "i4"))], ["key", "code", "part"])
    rows = [r for b in simhash._trees(batch(codes[i : i + 50]) for i in range(0, len(codes), 50)) for r in b.to_pylist()]
    nodes = [r for r in rows if r["kind"] == "node"]
    assert {r["tree"] & 0xFF for r in nodes} == set(range(len(codes) // 64 + (len(codes) % 64 > 0))) or len(nodes) > 4
    assert sorted(m for r in nodes for m in r["members"]) == codes.view("i8").tolist()


def test_gray_ranks_keep_prefixes_together():
    codes = np.random.default_rng(0).integers(0, 1 << 63, 1000, dtype=np.uint64)
    ranks = simhash.gray_rank(codes)
    assert np.array_equal(ranks ^ (ranks >> np.uint64(1)), codes)
    top = codes[np.argsort(ranks)] >> np.uint64(54)
    assert len(np.flatnonzero(np.diff(top.astype(int)))) + 1 == len(set(top.tolist()))


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(4).shuffle(order)
    edges = [*zip(order, order[1:]), (1000, 1001), (1001, 1000), (5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(200), 0), 1000: 1000, 1001: 1000}


def brute_repeats(rows, length=400):
    seen = collections.Counter(
        b[i : i + length] for _, t in rows for b in [(t or "").encode()] for i in range(len(b) - length + 1)
    )
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), bytes(gone).count(b"\0\1") + (gone[:1] == b"\1"), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def passages(seed):
    rng = random.Random(seed)
    shared = [words(rng, rng.choice([60, 90, 120, 300])) for _ in range(4)]
    rows = []
    for i in range(60):
        parts = [words(rng, rng.randint(0, 60)) for _ in range(3)]
        for _ in range(rng.randint(0, 2)):
            parts.insert(1, rng.choice(shared)[rng.randint(0, 30) :])
        rows.append((i, " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_match_brute_force(spark, seed):
    rows = passages(seed) + [(100, "ab" * 900), (101, "x" * 399), (102, "x" * 400), (103, "y" * 401), (104, None), (None, ""), (105, "né" * 300), (106, "né" * 300)]
    rows += [(200, rows[3][1]), (3, rows[3][1])]
    got = suffix_dedup.remove_repeated(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=repr) == brute_repeats(rows)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_suffix_array_and_common_prefixes():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 5, 300):
        text = rng.integers(0, alphabet, 400)
        order = suffix_dedup.suffix_array(text)
        plain = sorted(range(400), key=lambda i: text[i:].tolist())
        assert order.tolist() == plain
        common, before = suffix_dedup.common_prefixes(text, order, np.array([0, 150, 333]), 64)
        for x, y in zip(plain, plain[1:]):
            n = 0
            while max(x, y) + n < 400 and text[x + n] == text[y + n] and n < 64:
                n += 1
            assert (common[y], before[y]) == (n, x)


def test_shards_with_one_key_are_merged(monkeypatch):
    """One key over many shards gives the same starts as one shard."""
    monkeypatch.setattr(suffix_dedup, "SHARD", 256 * 8)
    rng = random.Random(3)
    rows = []
    for i in range(60):
        back = rng.randint(0, 100)
        left = rng.choice([b"p" * 200, b"q" * 200, bytes(rng.choices(b"xyz", k=200))])
        right = rng.choice([b"r" * 200, bytes(rng.choices(b"uvw", k=200))])
        rows.append({"key": 9, "_a": i, "_b": 0, "low": 0, "asks": i % 7 > 0, "left": left[200 - back :], "right": right[: suffix_dedup.WINDOW - 1]})
    schema = pa.schema([("key", pa.int64()), ("_a", pa.int64()), ("_b", pa.int32()), ("low", pa.int64()), ("asks", pa.bool_()), ("left", pa.binary()), ("right", pa.binary())])
    found = [r for b in suffix_dedup._shards(iter([pa.RecordBatch.from_pylist(rows, schema)])) for r in b.to_pylist()]
    borders = [r for r in found if r["kind"] == "border"]
    merged = pa.RecordBatch.from_pylist(borders, suffix_dedup._FOUND)
    got = {(r["_a"], p) for r in found if r["kind"] == "run" for p in range(r["low"], r["high"] + 1)}
    got |= {(r["_a"], r["low"]) for b in suffix_dedup._merged(iter([merged])) for r in b.to_pylist()}
    strings = collections.Counter()
    for r in rows:
        whole = r["left"] + b"|" + r["right"]
        for i in range(len(whole) - suffix_dedup.WINDOW + 1):
            strings[whole[i : i + suffix_dedup.WINDOW]] += 1
    want = set()
    for r in rows:
        whole = r["left"] + b"|" + r["right"]
        want |= {(r["_a"], i) for i in range(len(whole) - suffix_dedup.WINDOW + 1) if r["asks"] and strings[whole[i : i + suffix_dedup.WINDOW]] > 1}
    assert got == want and want


def test_long_texts_are_scanned_in_pieces(monkeypatch):
    """Pieces of a long text give the anchors of every start once."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1000)
    text = bytes(random.Random(1).choices(b"abcd", k=5000))
    batch = pa.RecordBatch.from_pylist([{"_a": 1, "_b": 2, "bytes": text}], pa.schema([("_a", pa.int64()), ("_b", pa.int32()), ("bytes", pa.binary())]))
    starts = []
    for b in suffix_dedup._anchor_rows(iter([batch])):
        for r in b.to_pylist():
            low = r["place"] - r["shape"] // suffix_dedup.WINDOW
            starts += range(low, low + r["shape"] % suffix_dedup.WINDOW + 1)
    assert sorted(starts) == list(range(5000 - 400 + 1))
