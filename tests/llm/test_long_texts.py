"""Very long and repetitive texts, and pages laid out against a plain renderer."""

import collections
import hashlib
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvartal.llm import decontaminate, exact_dedup, html_text, sharding, simhash, suffix_dedup, toxicity

DOCS = "doc_id long, text string"


def uncovered(rows, length=400):
    """Bytes that stay, by counting every string."""
    texts = [(t or "").encode() for _, t in rows]
    counts = collections.Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        spans = int(np.diff(np.r_[0, gone.astype(int)]).clip(0).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), bool(gone.any())))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_periodic_runs_match_brute_force(spark, seed):
    rng = random.Random(seed)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    rows = []
    for i in range(40):
        unit = letters(rng.choice([1, 1, 2, 3, 5, 8, 11]))
        run = (unit * 900)[: rng.choice([300, 399, 400, 401, 403, 450, 800, 1500])]
        rows.append((i, letters(rng.choice([0, 3, 200])) + run + letters(rng.choice([0, 3, 200]))))
    rows += [(100, "a" * 399), (101, "a" * 400), (102, "b" + "a" * 400 + "c"), (103, "a" * 401), (104, "ab" * 201), (105, "zq" * 200), (106, "qz" * 200)]
    rows += [(107, "w" * 2000), (108, None), (107, "w" * 2000)]
    got = suffix_dedup.remove_repeated(spark.createDataFrame(rows, DOCS).repartition(3)).drop("spans")
    assert sorted(map(tuple, got.collect()), key=repr) == uncovered(rows)


def test_runs_across_pieces(spark, monkeypatch):
    """A run is told piece by piece; the strings of its first period stand for the rest."""
    batch_rows = [(1, "pq" * 3000 + "end" * 40), (2, "x" + "pq" * 250 + "y"), (3, "pq" * 205)]
    got = suffix_dedup.remove_repeated(spark.createDataFrame(batch_rows, DOCS)).drop("spans").collect()
    assert sorted(map(tuple, got), key=repr) == uncovered(batch_rows)
    data = np.frombuffer(b"k" * 1000 + b"m" * 500 + b"0123" * 300, np.uint8)
    runs = suffix_dedup.periodic_runs(data, np.array([700, 1500, 2700]))
    assert (700, 1000, 1) not in runs and {(0, 700, 1), (1000, 1500, 1), (1500, 2700, 4)} <= set(runs)


def test_text_of_one_character_gives_few_anchors(spark):
    """Five million equal characters, beside a text that shares a stretch of them."""
    rows = [(1, "k" * 5_000_000), (2, "start " + "k" * 400 + " end"), (3, "k" * 399)]
    began = time.monotonic()
    got = {r.doc_id: r for r in suffix_dedup.remove_repeated(spark.createDataFrame(rows, DOCS)).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (5_000_000, 1) and got[1].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert (got[2].n_removed, [tuple(s) for s in got[2].spans]) == (400, [(6, 406)]) and not got[3].repeats
    assert time.monotonic() - began < 120


# --- contamination ------------------------------------------------------------------------------------


def contaminated(docs, items, size=13):
    out = []
    for d, text in docs:
        w = (text or "").split()
        hit, ids = set(), set()
        places = {}
        for i in range(len(w) - size + 1):
            places.setdefault(tuple(w[i : i + size]), []).append(i)
        for item, t in items:
            v = t.split()
            for window in {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}:
                for i in places.get(window, ()):
                    hit.update(range(i, i + size))
                    ids.add(item)
        out.append((d, len(w), len(hit), len(ids)))
    return sorted(out)


def test_contamination_of_repetitive_texts(spark):
    rng = random.Random(1)
    prose = [f"w{rng.randrange(300)}" for _ in range(600)]
    items = [
        (1, "no " * 2000), (2, "a b " * 300), (3, "a b c " * 100 + "end"), (4, " ".join(prose[100:160])),
        (5, "x no no no no no no no no no no no no"),
    ]
    docs = [
        (1, "no " * 3000), (2, "b a " * 400), (3, "q a b c a b c a b c a b c a b c end no"), (4, " ".join(prose)),
        (5, "no " * 12), (6, " ".join(prose[120:150]) + " no" * 40 + " a b" * 9), (7, "x " + "no " * 12 + "x"),
    ]
    began = time.monotonic()
    got = decontaminate.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got.collect()) == contaminated(docs, items)
    assert time.monotonic() - began < 60


# --- other operators on a text of millions of bytes ------------------------------------------------------


@pytest.fixture(scope="module")
def long_docs(spark):
    rng = random.Random(7)
    text = " ".join(f"w{rng.randrange(5000)}" for _ in range(700_000))
    return spark.createDataFrame([(1, text), (2, text), (3, text + "."), (4, "short one")], DOCS), text


def test_long_texts_in_exact_groups_and_shards(long_docs):
    docs, text = long_docs
    groups = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}
    assert groups == {1: (1, 2), 2: (1, 2), 3: (3, 1), 4: (4, 1)}
    sizes = {r.doc_id: r["size"] for r in sharding.byte_shards(docs).collect()}
    assert sizes == {1: len(text) + 1, 2: len(text) + 1, 3: len(text) + 2, 4: 10}


def test_long_texts_have_one_fingerprint_each(long_docs):
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(long_docs[0]).collect()}
    assert found == {1: 1, 2: 1, 3: 1, 4: 4}


def test_long_texts_are_scored_whole(spark):
    rng = random.Random(8)
    clean = lambda n: ". ".join(" ".join(f"w{rng.randrange(60)}" for _ in range(6)) for _ in range(n))
    rows = [(i, clean(5) + (" grubble" if i % 3 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    long_text = clean(150_000)
    docs = spark.createDataFrame([*rows, (1000, long_text), (1001, long_text + ". you grubble")], DOCS)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).where("doc_id >= 1000").collect()}
    # The last of 150,000 sentences is found, and nothing in the others.
    assert got[1001].predicted == 1 and got[1001].worst_score > 0.5 > got[1000].worst_score
    assert (long_text + ". you grubble")[got[1001].worst_start : got[1001].worst_end] == " you grubble"


# --- pages ------------------------------------------------------------------------------------------------


def tree(rng, depth, hidden, out):
    """HTML of a random tree; ``out`` gets the tokens that a reader sees, list marks included."""
    html = ""
    for _ in range(rng.randint(1, 4)):
        kind = rng.random()
        word = f"t{rng.randrange(10**6)}"
        if kind < 0.4 or depth == 0:
            html += f" {word} "
            if not hidden:
                out.append(word)
            continue
        style, unseen, gone = rng.choice([("", hidden, False)] * 4 + [
            (" style='visibility:hidden'", True, False), (' style="color:red; VISIBILITY : visible"', False, False),
            (" style=visibility:collapse", True, False), (" style='display:none'", hidden, True), (" hidden", hidden, True),
        ])
        inner = [] if gone else out
        if kind < 0.7:
            tag = rng.choice(["div", "span", "b", "section", "blockquote"])
            html += f"<{tag}{style}>{tree(rng, depth - 1, unseen, inner)}</{tag}>"
            continue
        start, backwards, n = rng.choice([None, 1, 5, -2]), rng.random() < 0.3, rng.randint(1, 4)
        ordered = kind < 0.9
        attrs = (f" start={start}" if start is not None else "") + (" reversed" if backwards else "") if ordered else ""
        number = start if start is not None else n if ordered and backwards else 1
        html += f"<{'ol' if ordered else 'ul'}{attrs}{style}>"
        for _ in range(n):
            value = rng.choice([None, None, 9])
            number = value if ordered and value is not None else number
            item_style, item_unseen = rng.choice([("", unseen), ("", unseen), (" style='visibility:hidden'", True), (" style='visibility:visible'", False)])
            first = f"t{rng.randrange(10**6)}"
            if not item_unseen:
                inner += [f"{number}." if ordered else "-", first]
            html += f"<li{f' value={value}' if value is not None else ''}{item_style}>{first} {tree(rng, depth - 1, item_unseen, inner) if rng.random() < 0.4 else ''}"
            html += rng.choice(["", "</li>"])
            number += -1 if ordered and backwards else 1
        html += "</ol>" if ordered else "</ul>"
    return html


@pytest.mark.parametrize("seed", range(150))
def test_pages_show_what_a_plain_renderer_shows(seed):
    rng, out = random.Random(seed), []
    page = tree(rng, 4, False, out)
    assert html_text.extract(page).split() == out


@pytest.mark.parametrize("page, text", [
    ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span>no</div>", "yes"),
    ("<ol start=5><li>a<li value=9>b<li>c</ol>", "5. a\n9. b\n10. c"),
    ("<ol reversed><li>a<li>b</ol>", "2. a\n1. b"), ("<ol start=x><li value=''>a</ol>", "1. a"),
    ("<textarea>\nx\n y</textarea>", "x\n y"), ("<textarea>\r\nx</textarea>", "x"), ("<textarea>\n\nx</textarea>", "\nx"),
    ("<table style='visibility:hidden'><tr><td>no<td style='visibility:visible'>yes</table>", "  yes"),
    ("<p style='visibility:hidden'>a<br>b</p>c", "c"), ("<p style='mask-visibility:hidden'>a", "a"),
    ("<div style='visibility:hidden; visibility:visible'>a</div>", "a"),
])
def test_visibility_numbers_and_textareas(page, text):
    assert html_text.extract(page) == text


def test_one_long_line_is_joined_once():
    page = "<b>word</b> " * 160_000
    began = time.process_time()
    assert html_text.extract(page) == " ".join(["word"] * 160_000)
    small = page[: len(page) // 8]
    mid = time.process_time()
    html_text.extract(small)
    assert mid - began < 16 * max(time.process_time() - mid, 0.02)
