"""Toxicity, packing, HTML extraction, urls, shards, chat, decontamination and the pipeline."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from kvartal.llm import chat, decontaminate, html_text, packing, sharding, toxicity, url_filter

DOCS = "doc_id long, text string"
ODD = "doc_id long, text string, score double, _rest int, _id int, item_id int, `a.b` int"
BAD = ["grubble", "snorkish", "flimwit"]


def prose(rng, n, bad=False):
    words = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(2, 7))) for _ in range(n)]
    if bad:
        words[rng.randrange(n)] = rng.choice(BAD) + rng.choice(["", "s", "ed", "ing"])
    return re.sub(r"((?:\S+ ){6}\S+)", r"\1.", " ".join(words))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randint(5, 60), i % 5 == 0), int(i % 5 == 0)) for i in range(900)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(5000, None), (5001, ""), (None, "plain words"), (5001, "")], DOCS)
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] + [(0, 0), (7777, 1), (3, None)], "doc_id long, toxic int")
    return rows, docs, labels


def test_toxicity_on_held_out_rows(labelled):
    rows, docs, labels = labelled
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == 904
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert {r.score for r in got if r.doc_id in (5000, 5001)} == {0.0}
    held = [r for r in got if r.held_out and r.doc_id < 900]
    right = [r.predicted == (r.doc_id % 5 == 0) for r in held]
    assert len(held) > 200 and sum(right) / len(right) > 0.97
    texts = dict(r[:2] for r in rows)
    worst = [texts[r.doc_id][r.worst_start : r.worst_end] for r in held if r.predicted]
    assert sum(any(b in w for b in BAD) for w in worst) / len(worst) > 0.95


def test_offending_sentences(labelled):
    rows, docs, labels = labelled
    found = toxicity.offending_sentences(docs, labels).collect()
    assert len(found) > 100 and sum(any(b in r.sentence for b in BAD) for r in found) / len(found) > 0.95


def test_labels_of_held_out_rows_do_not_matter(labelled):
    _, docs, labels = labelled
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {(r.doc_id, r.score) for r in toxicity.toxicity(docs, labels).collect()} == {(r.doc_id, r.score) for r in toxicity.toxicity(docs, flipped).collect()}


def test_labels_of_absent_documents_and_repeated_rows_do_not_matter(spark, labelled):
    _, docs, labels = labelled
    scores = lambda d, x: {(r.doc_id, r.score) for r in toxicity.toxicity(d, x).collect()}
    expected = scores(docs, labels)
    assert len({s for _, s in expected}) > 100
    absent = spark.range(100_000, 160_000).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS toxic")
    assert scores(docs, labels.unionByName(absent)) == expected
    repeats = docs.where("doc_id IN (5, 10, 15, 16)").crossJoin(spark.range(60)).select("doc_id", "text")
    assert scores(docs.unionByName(repeats), labels) == expected


def test_sample_bounds_rows(spark, labelled, monkeypatch):
    _, docs, labels = labelled
    monkeypatch.setattr(toxicity, "SAMPLE", {1: 20, 0: 30})
    many = docs.where("doc_id < 900").crossJoin(spark.range(3).toDF("n")).selectExpr("doc_id", "text || ' ' || n AS text")
    rows, counts = toxicity.drawn(many, labels)
    assert {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()} == {1: 20, 0: 30}
    assert sum(counts.values()) > 500


def test_toxicity_without_labels_or_rows(spark, labelled):
    _, docs, labels = labelled
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.5}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    odd = spark.createDataFrame([(1, None, 1.0, 2, 3, 4, 5), (2, "fine", None, None, None, None, None)], ODD)
    kept = toxicity.drop_toxic(odd, labels)
    assert kept.columns == odd.columns[:6] + ["a.b"] and kept.count() == 2


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(2)
    rows = [(i, prose(rng, int(rng.paretovariate(0.8) * 20) % 3000 + 1)) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "<|endoftext|> a\n\n\n b"), (203, "naïve  \n\t 東京 🙂"), (None, "x"), (204, rows[0][1])]
    got = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3)).toPandas()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        pieces = got[got["doc_id"].isna() if doc_id is None else got["doc_id"] == doc_id].sort_values("start")
        at = 0
        for p in pieces.itertuples():
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    sizes = []
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist()
        sizes.append(s["length"].sum())
    assert max(sizes) <= 2048 and sum(x < 2048 for x in sizes) <= 3
    assert packing.pack(spark.createDataFrame([], DOCS)).count() == 0


def test_long_texts_are_tokenised_alike_in_pieces(monkeypatch):
    encode = packing.Encoder("byte_bpe_50k.json")
    text = "\n".join(prose(random.Random(i), 30) for i in range(40)) + "\n\n \n x" * 20
    whole = encode(text)
    monkeypatch.setattr(packing, "PIECE", 100)
    assert np.array_equal(encode(text), whole)


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 4), max_size=6), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_best_fill_is_closest(counts, room):
    fill = packing.best_fill(counts, room)
    assert all(0 < n <= counts[x] for x, n in fill)
    sums = {0}
    for x, n in counts.items():
        sums = {s + x * k for s in sums for k in range(n + 1)}
    assert sum(x * n for x, n in fill) == max(s for s in sums if s <= room)


def test_lengths_that_never_fit_are_cut():
    packer = packing.Packer(0, 100)
    for i in range(50):
        packer.add(i, np.arange(70, dtype="<u4"))
    packer.pack(last=False)
    assert packer.held == 50 and not packer.out
    packer.pack(last=True)
    sizes = collections.Counter()
    for _, _, n, _, _, sequence, _ in packer.out:
        sizes[sequence] += n
    assert len(sizes) == 35 and set(sizes.values()) == {100}


@pytest.mark.parametrize("page, text", [
    ("<p>one<p>two <b>bold</b>", "one\n\ntwo bold"),
    ("<ul><li>a<li>b<ol><li>c</ol></ul>x", "- a\n- b\n  1. c\n\nx"),
    ("<table><tr><th>h<th>long head<tr><td>cell<td>x</table>", "h     long head\ncell  x"),
    ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("<p hidden>no</p><p style='DISPLAY : none'>no</p><script>if (a<b) x()</script><title>t</title>yes", "yes"),
    ("a &amp; b &lt;c&gt; &eacute;", "a & b <c> é"),
    ("<!-- x --><![CDATA[y]]> <a title='a>b'>link</a", "y link"),
    ("<blockquote>q</blockquote>after", "    q\n\nafter"),
    ("<style>p{}", ""), ("", ""), ("   ", ""), ("<", "<"), ("a<b", "a"), ("</p></div>x", "x"),
    ("<details><summary>s</summary>folded</details>", "s"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<html><head><title>T</title><h1>Hi</h1><p>text", "Hi\n\ntext"),
    ("<head> <meta charset=x><basefont size=3>\n<link rel=y><style>p{}</style> bare <b>text</b>", "bare text"),
    ("<head><script>x()</script><![CDATA[y]]></head>z", "yz"), ("<head></br>y", "\ny"),
    ("<head>&nbsp;<title>T</title>after", "\xa0after"),
])
def test_html_layout(page, text):
    assert html_text.extract(page) == text


@given(st.lists(st.sampled_from(["<p>", "</p>", "<ul>", "<li>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "<pre>", "</pre>", "<div>", "x1", " x2 ", "<!--", "'", '"', "<a href="]), max_size=30))
@settings(max_examples=300, deadline=None)
def test_html_never_fails(parts):
    html_text.extract("".join(parts))


@pytest.mark.parametrize("page, text", [
    ("<table><tr><td><p>a<p>b<ul><li>c<li>d</ul><td>side</table>x", "a\n\nb\n\n- c\n- d\n\nside\n\nx"),
    ("<table><tr><td>a<br>bb<td>c<tr><td>long<td><ul><li>d<li>e</ul></table>", "a     c\nbb\nlong  - d\n      - e"),
    ("<table><tr><td><pre>a\n  b\n\n\nc</pre></table>x", "a\n  b\n\n\nc\n\nx"),
    ("<table><tr><td>nav<td><table><tr><td>a<td>b<tr><td>long<td>d</table><tr><td>x<td>y</table>", "nav\n\na     b\nlong  d\n\nx  y"),
    ("<table><tr><th colspan=2>wide head<th>z<tr><td>a<td>b<td>c</table>", "wide head  z\na  b       c"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td>d<td>e</table>", "a  b\n   c\nd  e"),
    ("<table><tbody><tr><td rowspan=0>a<td>b<tr><td>c<tbody><tr><td>d</table>", "a  b\n   c\nd"),
    ("<table><tr><td>" + "y" * 300 + "<td>b<tr><td>c<td>d</table>", "y" * 300 + "  b\nc  d"),
    ("<table><tr><td>" * 200 + "<ul><li>a<li>b</ul>", "- a\n- b"),
])
def test_html_cells_keep_their_lines_and_columns(page, text):
    assert html_text.extract(page) == text


BELOW = [
    ("<div hidden>no<p>no</div>a", "a"), ("<svg>no<b>no</b></svg>a<video>no</video>", "a"),
    ("<details><summary>s</summary>no<b>no</b></details>", "s"),
    ("<ol><li>a<li>b<ul><li>c</ul></ol>", "1. a\n2. b\n   - c"), ("<pre>a\n  b</pre>", "a\n  b"),
    ("<table><tr><td>a<td>b<tr><td>long<td>d</table>", "a     b\nlong  d"),
    ("<div style='display:none'>no<div>no</div>no</div>a", "a"),
]


@pytest.mark.parametrize("page, text", BELOW)
@pytest.mark.parametrize("above", ["<span>" * 200, "<a name=x><font>" * 200, "<div>" * 200, "<b>" * 30_000])
def test_html_layout_at_any_depth(above, page, text):
    assert html_text.extract(page) == html_text.extract(above + page) == text


@pytest.mark.parametrize("page, text", [
    ("<a hidden>no<a>yes", "yes"), ("<a hidden><span>no<a>yes", "yes"), ("<a><b hidden>no<a>no", ""),
    ("<a><div hidden>no<a>no</div>yes", "yes"), ("<a>x<svg><a>no</svg>y", "xy"),
])
def test_html_links_close_links(page, text):
    assert html_text.extract(page) == text


def test_html_deep_nesting_and_rows(spark):
    assert html_text.extract("<div>" * 5000 + "deep").strip() == "deep"
    rows = [(1, "<p>a<p>b"), (1, "<p>a<p>b"), (2, None), (None, "")]
    got = sorted(map(tuple, html_text.visible_text(spark.createDataFrame(rows, "page_id long, html string")).collect()), key=repr)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == sorted([(1, "a\n\nb", 4, 3, sha("a\n\nb"))] * 2 + [(2, "", 0, 0, sha("")), (None, "", 0, 0, sha(""))], key=repr)


def brute_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = max(((len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return (host, path, best[3] if best else None, best[4] if best else "allow")


def test_urls_match_brute_force(spark):
    rng = random.Random(1)
    names = ["net", "org", "example", "a", "b-c", "", "x0"]
    rules = list(url_filter.RULES) + [("a.net", "/", "allow"), ("b-c.a.net", "/x", "block"), ("a.net", "/x/y", "block"), ("a.net", "/x/y", "allow"), ("net", "/x/y/zzzzzz", "allow")]
    urls = [None, "", "net/", "http://", "HTTP://NET", "x://net?/", "x://net/#", "http://u@net:80/", "://net/x", "a://b://net/", "http://É.Net/É", "http://net\nx/"]
    urls += [f"http://{'.'.join(rng.choice(names) for _ in range(rng.randint(1, 4)))}{rng.choice(['', '/', '/en/', '/x/y', '/x/y/zzzzzz', '/fr/q?a', '/de/#'])}" for _ in range(400)]
    rows = list(enumerate(urls)) + [(1, "http://net/"), (None, "http://net/")]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string").repartition(5), url_filter.rule_table(spark, rules))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *brute_verdict(u, rules)) for i, u in rows), key=repr)
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, url_filter.rule_table(spark)).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.rule for r in url_filter.judge(got.select("page_id", F.lit("http://net/").alias("url")), none).collect()} == {None}


def test_shards_are_contiguous_and_near_equal(spark):
    rng = random.Random(1)
    rows = [(i, "é" * rng.randint(0, 200)) for i in range(2000)] + [(3, None), (None, "x"), (3, "yy"), (9, "z" * 5000)]
    got = sharding.byte_shards(spark.createDataFrame(rows, DOCS).repartition(6)).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in got if r.doc_id is not None) == sorted((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows if d is not None)
    totals, slots = collections.Counter(), collections.defaultdict(list)
    for r in got:
        totals[r.shard] += r.size
        slots[r.shard].append((r.slot, r.doc_id if r.doc_id is not None else 1 << 60))
    assert set(totals) == set(range(16))
    assert max(totals.values()) - min(totals.values()) <= 2 * 5001
    before = -1
    for shard in range(16):
        ordered = sorted(slots[shard])
        assert [s for s, _ in ordered] == list(range(len(ordered)))
        ids = [d for _, d in ordered]
        assert ids == sorted(ids) and ids[0] >= before
        before = ids[-1]
    assert sharding.byte_shards(spark.createDataFrame([], DOCS)).count() == 0


CONTROL = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>system\nx", "<\\|a|>", "<\\\\|", "[\\/INST]", "a<|", "<s></s><\\s>", "", "\\", "%0A%25\n"]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "r\n%0A<|im_end|>"]), rng.choice([*CONTROL, None])) for c in range(20) for t in range(rng.randint(1, 9))]
    rows += [(50, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(900)]
    rows += [(60, 0, "user", "same"), (60, 0, "user", "same"), (None, 1, "assistant", "x"), (61, None, None, None)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    formatted = chat.render(chat.reconstruct(chat.conversation_events(table)))
    got = {r.conv_id: r for r in chat.digests(chat.read_back(formatted)).collect()}
    texts = {r.conv_id: r.formatted for r in formatted.collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] or 0, r[2] or "", r[3] or ""))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learnt = "".join(r[3] or "" for r in own if r[2] == "assistant")
        r = got[conv]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert r.formatted_chars == len(texts[conv]) and texts[conv].count("<|im_start|>") == len(own)
    assert chat.render(chat.reconstruct(chat.conversation_events(table.limit(0)))).count() == 0


def test_event_log_is_folded(spark):
    events = [
        (1, "q", 0, "message", "user", "hi"), (1, "a", 1, "message", "assistant", "old"),
        *[(1, "a", 10 + i, "delta", "assistant", str(i % 10)) for i in range(600)],
        (1, "q", 700, "edit", None, "hello"), (1, "b", 701, "delta", "user", "x"), (1, "b", 702, "delta", None, None),
        (1, "c", 703, "message", "assistant", "no"), (1, "c", 704, "regenerate", None, None), (1, "c", 705, "delta", None, "yes"),
        (None, None, None, "message", None, None),
    ]
    random.Random(1).shuffle(events)
    got = chat.reconstruct(spark.createDataFrame(events, chat.EVENTS)).collect()
    assert sorted(((r.conv_id, r.sequence, r.role, r.text) for r in got), key=repr) == sorted([
        (1, 0, "user", "hello"), (1, 1, "assistant", "old" + "".join(str(i % 10) for i in range(600))),
        (1, 701, "user", "x"), (1, 703, "assistant", "yes"), (None, None, None, ""),
    ], key=repr)


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(docs, items):
    out = []
    for d, t in docs:
        w, hit, ids = tokens(t), set(), set()
        for item, text in items:
            v = tokens(text)
            n = min(13, len(v))
            windows = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if v else set()
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    ids.add("" if item is None else str(item))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def benchmark_case(seed):
    rng = random.Random(seed)
    pool = ["the", "of", "É1", "ça", "x", "yy", *("w%d" % i for i in range(30))]
    phrase = lambda n: " ".join(rng.choice(pool) for _ in range(n))
    items = [(i, phrase(rng.choice([1, 3, 13, 14, 20, 40]))) for i in range(12)] + [(90, ""), (91, None), (None, phrase(15)), (5, phrase(13)), (92, "the " * 20), (93, "..."), (1, phrase(2))]
    docs = []
    for i in range(60):
        parts = [phrase(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            item = rng.choice(items)[1] or ""
            parts.append(", ".join(item.split()[rng.randint(0, 3) :]).upper() if i % 2 else item)
        docs.append((i, "\n".join(parts)))
    return docs + [(100, None), (101, ""), (None, items[3][1]), (7, docs[8][1]), (102, "the " * 50)], items


@pytest.mark.parametrize("seed", [1, 2])
def test_contamination_matches_brute_force(spark, seed):
    docs, items = benchmark_case(seed)
    got = decontaminate.contamination(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_contamination(docs, items)


def test_contamination_of_empty_tables_and_odd_columns(spark):
    docs, items = benchmark_case(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    frame = spark.createDataFrame(docs, DOCS)
    assert decontaminate.contamination(frame.limit(0), bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(frame, bench.limit(0)).collect()} == {0}
    odd = spark.createDataFrame([(1, items[3][1], 1.0, 2, 3, 4, 5), (2, None, None, None, None, None, None), (3, "clean", 0.0, 0, 0, 0, 0)], ODD)
    kept = decontaminate.drop_contaminated(odd, bench)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3]


def test_proximity_matches(spark):
    docs = [(1, "a b q c d r e"), (2, "q " + "z " * 30 + "r"), (3, "r x q q"), (4, None), (5, "only q here")]
    queries = [(1, "q r"), (2, "e"), (3, "nothing here")]
    got = decontaminate.proximity_matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(queries, "query_id long, text string"), 5)
    found = {(r.query_id, r.doc_id, r.start, r.stop) for r in got.collect()}
    assert {(1, 1, 2, 5), (2, 1, 6, 6)} <= found
    assert {(q, d) for q, d, _, _ in found if q == 1} == {(1, 1), (1, 3)}


def brute_proximity(docs, queries, within):
    split = lambda t: re.findall("[a-z0-9]+", (t or "").lower())
    counts = collections.Counter(w for _, t in docs for w in split(t))
    out = []
    for q, text in queries:
        wanted = sorted(set(split(text)), key=lambda w: (counts[w], w))
        for d, t in docs:
            w = split(t)
            for at in (i for i, x in enumerate(w) if wanted and x == wanted[0]):
                spans = [(b - a, a, b) for a in range(at + 1) for b in range(at, len(w)) if b - a < within and set(wanted) <= set(w[a : b + 1])]
                out += [(q, d, *min(spans)[1:])] if spans else []
    return sorted(out, key=repr)


def test_proximity_needs_every_word(spark):
    rng = random.Random(4)
    docs = [(1, "q r"), (2, "q r s"), (3, "s r q x r s"), (4, None), (5, ""), (5, "q x r q s"), (5, "q x r q s"), (None, "s q r")]
    docs += [(i, " ".join(rng.choice("abcdefqrs") for _ in range(rng.randint(0, 60)))) for i in range(10, 40)]
    queries = [(1, "q r s"), (2, "a B c d"), (3, "e, e"), (4, "a b"), (5, "a zz b"), (6, ""), (7, "a b c d e f q")]
    for within in (1, 4, 9):
        got = decontaminate.proximity_matches(spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(queries, "query_id long, text string"), within)
        assert got.columns == ["query_id", "doc_id", "start", "stop"]
        assert sorted(map(tuple, got.collect()), key=repr) == brute_proximity(docs, queries, within)


def test_pipeline_stages(spark, tmp_path, labelled):
    rows, docs, labels = labelled
    rng = random.Random(9)
    item = prose(rng, 40)
    base = prose(rng, 300)
    near = base.replace(base.split()[150], "zzz", 1)
    extra = [(2000, base), (2001, base.replace(" ", "  ")), (2002, near), (2003, item), (2004, "fine words follow here")]
    frame = docs.unionByName(spark.createDataFrame(extra, DOCS)).where("doc_id IS NOT NULL")
    frame = frame.withColumn("lang", F.lit("en")).withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long"))
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == frame.columns, name
    ids = {r.doc_id for r in kept.collect()}
    assert {2000, 2004} <= ids and not {2001, 2002, 2003} & ids
    clean = {i for i, t, bad in rows if not bad}
    assert len(clean - ids) < 0.03 * len(clean) and len(ids & {i for i, _, bad in rows if bad}) < 10
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == ids
