"""Phrases whose words stand together more often than chance, by best-first growth from prefixes.

A phrase that grows from a word ``w`` can be cut after ``w``: its score is at most 1000 n / f(w),
however far it grows. The frontier holds the words not grown yet, highest bound first. Each wave
takes the first ones, grows them word by word to all phrases that occur often enough, one pass over
the coded corpus per word, and scores these; the search ends when no bound in the frontier
reaches the last score that would be returned.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvartal.operators.numbering import with_position
from kvartal.session import discard, materialise

LEAST = 100
LONGEST = 5
TOP = 2000
# Words of a chunk of the coded corpus.
CHUNK = 2_000_000
# Phrases that a pass over the corpus grows or counts at most: what is broadcast.
BATCH = 100_000
# The first wave grows words that make up this part of the corpus, each further one four times as much.
PART, WIDER = 16, 4
# Up to so many frequent words are broadcast to code the corpus; more are joined.
SHARED = 500_000
# Occurrences that a task holds before it counts them.
HELD = 2_000_000

WORD_BITS = 32
# Bytes of a text: A-Z lowered, a tab is a space, all that ends a piece is a line feed.
TEXT_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else 32 if b == 9 else 10 if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256)
)


class Numbered(dict):
    """Word -> number from 1, in order of first use."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def chunked(docs: DataFrame, size: int) -> DataFrame:
    """lang, words, counts, codes: runs of pieces, each with its own dictionary.

    ``codes`` are places in ``words`` from 1, with 0 after each piece.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[Numbered, array]] = {}
        n = 0

        def flushed():
            rows = []
            for lang, (known, codes) in held.items():
                words = pa.array(list(known), pa.binary()).cast(pa.string())
                counts = np.bincount(np.frombuffer(codes, np.int32), minlength=len(known) + 1)[1:]
                rows.append((lang, words, pa.array(counts), codes.tobytes()))
            held.clear()
            lists = (
                pa.ListArray.from_arrays(np.cumsum([0, *map(len, x)], dtype=np.int32), pa.concat_arrays(x))
                for x in ([r[1] for r in rows], [r[2] for r in rows])
            )
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), *lists, pa.array([r[3] for r in rows], pa.binary())],
                ["lang", "words", "counts", "codes"],
            )

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not text.is_valid:
                    continue
                for piece in text.as_buffer().to_pybytes().translate(TEXT_BYTES).split(b"\n"):
                    if words := piece.split():
                        if (own := held.get(lang)) is None:
                            own = held[lang] = (Numbered(), array("i", [0]))
                        known, codes = own
                        codes.extend(map(known.__getitem__, words))
                        codes.append(0)
                        n += len(words)
                        if n >= size:
                            yield flushed()
                            n = 0
        if held:
            yield flushed()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").mapInArrow(
        cut, "lang string, words array<string>, counts array<bigint>, codes binary"
    )


def coded(chunks: DataFrame, words: DataFrame, shared: int) -> DataFrame:
    """The chunks as ids of frequent words; 0 for rare words and between pieces.

    The words are broadcast if they are few, a checked number. Beyond it each chunk gets the ids
    of its own words by a join, so that no task needs the whole vocabulary.
    """
    if words.count() <= shared:
        rows = words.select("lang", "phrase", "id").toArrow()
        known: dict[str, dict[str, int]] = {}
        for lang, word, id_ in zip(*(rows[c].to_pylist() for c in ("lang", "phrase", "id"))):
            known.setdefault(lang, {})[word] = id_
        vocabulary = chunks.sparkSession.sparkContext.broadcast(known)

        def by_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for lang, own, codes in zip(*batch.columns):
                    ids = vocabulary.value.get(lang.as_py(), {})
                    table = np.fromiter((ids.get(w, 0) for w in ["", *own.as_py()]), np.int32, len(own) + 1)
                    out.append(table[np.frombuffer(codes.as_buffer(), np.int32)].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["codes"])

        return chunks.select("lang", "words", "codes").mapInArrow(by_words, "codes binary")
    entries = chunks.select("chunk", "lang", F.posexplode("words").alias("_at", "phrase"))
    own = (
        entries.join(words.select("lang", "phrase", "id"), ["lang", "phrase"])
        .groupBy("chunk").agg(F.collect_list(F.struct("_at", "id")).alias("_own"))
    )
    rows = chunks.select("chunk", "codes").join(own, "chunk").select("codes", "_own._at", "_own.id")

    def by_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for codes, at, ids in zip(*batch.columns):
                codes = np.frombuffer(codes.as_buffer(), np.int32)
                table = np.zeros(codes.max() + 1, np.int32)
                table[at.values.to_numpy() + 1] = ids.values.to_numpy()
                out.append(table[codes].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["codes"])

    return rows.mapInArrow(by_join, "codes binary")


class Trie:
    """Phrases to grow (``grown``) or to count (``wanted``), with the nodes on the way to them."""

    def __init__(self, grown: list[tuple[int, ...]], wanted: list[tuple[int, ...]]):
        nodes: list[dict[tuple[int, int], int]] = [{} for _ in range(LONGEST)]
        n = 0

        def node(words: tuple[int, ...]) -> int:
            nonlocal n
            at = 0
            for level, word in enumerate(words):
                found = nodes[level].get((at, word))
                if found is None:
                    found = nodes[level][at, word] = n
                    n += 1
                at = found
            return at

        self.grown_nodes, self.wanted_nodes = [node(w) for w in grown], [node(w) for w in wanted]
        self.grows, self.counts = np.zeros(n, bool), np.zeros(n, bool)
        self.grows[self.grown_nodes] = True
        self.counts[self.wanted_nodes] = True
        self.levels = []
        for found in nodes:
            keys = np.array([(at << WORD_BITS) | word for at, word in found], np.int64)
            order = np.argsort(keys)
            self.levels.append((keys[order], np.array(list(found.values()), np.int64)[order]))

    def occurrences(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Key (node, next word) and word before, of all places of the phrases.

        Phrases that are only counted have 0 as the next word.
        """
        words = np.concatenate([words, np.zeros(LONGEST + 1, words.dtype)]).astype(np.int64)
        at = np.flatnonzero(words)
        node = np.zeros(len(at), np.int64)
        for level, (keys, nodes) in enumerate(self.levels):
            if not len(keys) or not len(at):
                return
            key = (node << WORD_BITS) | words[at + level]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            at, node = at[hit], nodes[place[hit]]
            counted = at[self.counts[node]]
            yield node[self.counts[node]] << WORD_BITS, np.full(len(counted), -1)
            go = words[at + level + 1] > 0
            at, node = at[go], node[go]
            grows = self.grows[node]
            here = at[grows]
            yield (node[grows] << WORD_BITS) | words[here + level + 1], words[here - 1]


def counted_together(key: np.ndarray, before: np.ndarray) -> pa.RecordBatch:
    """key, f, and the word before if it is the same each time, else -1."""
    order = np.argsort(key)
    key, before = key[order], before[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    low, high = np.minimum.reduceat(before, first), np.maximum.reduceat(before, first)
    same = np.where(low == high, low, -1).astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(key[first]), pa.array(np.diff(np.r_[first, len(key)])), pa.array(same)], ["key", "f", "before"]
    )


def counts_of(corpus: DataFrame, trie: Trie) -> DataFrame:
    """node, word, f, led: how often each grown phrase is followed by each word (word 0: itself).

    ``led``: the longer phrase always has the same word before it.
    """
    shared = corpus.sparkSession.sparkContext.broadcast(trie)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, held, n = shared.value, [], 0
        for batch in batches:
            for codes in batch.column(0):
                for found in trie.occurrences(np.frombuffer(codes.as_buffer(), np.int32)):
                    held.append(found)
                    n += len(found[0])
                if n >= HELD:
                    yield counted_together(*map(np.concatenate, zip(*held)))
                    held, n = [], 0
        if n:
            yield counted_together(*map(np.concatenate, zip(*held)))

    partial = corpus.mapInArrow(count, "key bigint, f bigint, before int")
    word = F.col("key").bitwiseAND(F.lit((1 << WORD_BITS) - 1))
    return (
        partial.groupBy("key").agg(
            F.sum("f").alias("f"), ((F.min("before") == F.max("before")) & (F.min("before") > 0)).alias("led")
        )
        .select(F.shiftright("key", WORD_BITS).alias("node"), word.alias("word"), "f", "led")
        .where((F.col("word") == 0) | (F.col("f") >= LEAST))
    )


def score(l: Column | str, r: Column | str) -> Column:
    """floor(1000 a n / (l r)), exactly: 38 digits hold the products."""
    exact = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")
    top = (F.lit(1000).cast("decimal(38,0)") * F.col("a") * F.col("n")).cast("decimal(38,0)")
    return F.call_function("div", top, (exact(l) * (F.col(r) if isinstance(r, str) else r)).cast("decimal(38,0)"))


def cut_scores(phrases: DataFrame, known: DataFrame) -> DataFrame:
    """Each phrase with its cuts (k, l, rest, r, score); r is null while the rest has not been counted,
    and the score then an upper bound, since the rest is met at least as often as the phrase."""
    size = F.size("ids")
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
    cuts = cuts.withColumn("rest", F.array_join(F.slice(F.split("phrase", " "), F.col("k") + 1, size - F.col("k")), " "))
    known = known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(known, ["lang", "rest"], "left")
    cuts = cuts.withColumn("l", F.element_at("pre", F.col("k"))).withColumn("score", score("l", F.coalesce("r", "a")))
    kept = [c for c in phrases.columns if c not in ("lang", "phrase")]
    return cuts.groupBy("lang", "phrase").agg(
        *(F.first(c).alias(c) for c in kept),
        # A count may be there twice, as a rest's and as a phrase's: they are equal.
        F.sort_array(F.collect_set(F.struct("score", "k", "l", "r", F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("rest_ids"), "rest"))).alias("cuts"),
    )


def best_of(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


RESULT = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
PHRASE = ("lang", "n", "phrase", "ids", "pre", "a", "led")


class Search:
    """The tables of one search: the coded corpus, the frequent words, all counts, and the best phrases."""

    def __init__(self, docs: DataFrame, top: int, chunk: int, shared: int):
        self.spark, self.top = docs.sparkSession, top
        chunks = materialise(chunked(docs, chunk).withColumn("chunk", F.monotonically_increasing_id()), "phrase-chunks")
        totals = materialise(
            chunks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n")),
            "phrase-totals",
        )
        entries = chunks.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("e"))
        words = (
            entries.groupBy("lang", F.col("e.words").alias("phrase")).agg(F.sum("e.counts").alias("f"))
            .where(F.col("f") >= LEAST).join(totals, "lang")
        )
        # Ids follow the counts, so the frontier is in the order of the ids: rarer words have higher bounds.
        self.words = materialise(with_position(words, ["f", "lang", "phrase"], "id"), "phrase-words")
        self.corpus = materialise(coded(chunks, self.words, shared), "phrase-corpus")
        discard(chunks)  # all that was made of it is written
        self.size = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        self.known = [self.words.select("lang", "phrase", "f")]
        self.best = None

    def with_least(self, df: DataFrame) -> DataFrame:
        """Add the score that a phrase of the language must reach: that of the last of the best, if they are all there."""
        if self.best is None:
            return df.withColumn("least", F.lit(0).cast("long"))
        last = self.best.where(F.col("rank") == self.top).select("lang", F.col("score").alias("_least"))
        return df.join(last, "lang", "left").withColumn("least", F.coalesce("_least", F.lit(0))).drop("_least")

    def frontier(self, after: int, mass: int) -> pa.Table:
        """The next words, by falling bound: at most BATCH, of at most ``mass`` occurrences but for one."""
        bound = F.expr("1000 * CAST(n AS DECIMAL(38,0)) div f")
        front = self.with_least(self.words.where(F.col("id") > after)).where(bound >= F.col("least"))
        rows = front.orderBy("id").limit(BATCH).select(
            "lang", "n", "phrase", F.array("id").alias("ids"), F.array("f").alias("pre"), F.col("f").alias("a")
        ).toArrow()
        return rows.slice(0, max(1, int(np.searchsorted(np.cumsum(rows["a"].to_numpy()), mass, "right"))))

    def with_nodes(self, table: pa.Table, nodes: list[int]) -> DataFrame:
        return self.spark.createDataFrame(table.append_column("node", pa.array(nodes, pa.int64())))

    def grow(self, rows: pa.Table) -> DataFrame:
        """The phrases that are one word longer and occur often enough."""
        trie = Trie([tuple(x) for x in rows["ids"].to_pylist()], [])
        parents = self.with_nodes(rows.select(["lang", "n", "phrase", "ids", "pre"]), trie.grown_nodes)
        words = self.words.select(F.col("id").alias("word"), F.col("phrase").alias("_last"))
        found = counts_of(self.corpus, trie).join(parents, "node").join(words, "word").select(
            "lang", "n", F.concat_ws(" ", "phrase", "_last").alias("phrase"),
            F.array_append("ids", F.col("word")).alias("ids"), F.array_append("pre", F.col("f")).alias("pre"),
            F.col("f").alias("a"), "led",
        )
        found = materialise(found, "phrase-found")
        self.known.append(found.select("lang", "phrase", F.col("a").alias("f")))
        return found

    def grown(self, rows: pa.Table) -> list[DataFrame]:
        """All phrases that grow from the words, one table for each pass over the corpus."""
        tables, level = [], [rows]
        for length in range(2, LONGEST + 1):
            found = [self.grow(batch) for batch in level]
            tables += found
            if length < LONGEST:
                level = [batch for table in found for batch in self.batches(table, "lang", "n", "phrase", "ids", "pre")]
        return tables

    def batches(self, table: DataFrame, *columns: str) -> Iterator[pa.Table]:
        """The rows in batches of bounded size."""
        last = None
        while True:
            rest = table if last is None else table.where(F.struct("lang", "phrase") > F.struct(*(F.lit(x).alias(c) for c, x in last.items())))
            rows = rest.select(*columns).orderBy("lang", "phrase").limit(BATCH).toArrow()
            if rows.num_rows:
                yield rows
            if rows.num_rows < BATCH:
                return
            last = {c: rows[c][-1].as_py() for c in ("lang", "phrase")}

    def score(self, tables: list[DataFrame]) -> None:
        """Score the phrases of a wave, but for those that always stand inside a longer one.

        Such a phrase has the same word before it each time, or grows without losing an occurrence.
        """
        found = reduce(DataFrame.unionByName, tables)
        size = F.size("ids")
        followed = found.where((size > 2) & (F.col("a") == F.element_at("pre", size - 1)))
        closed = F.col("led") & (size < LONGEST)
        alone = found.where(~closed).join(followed.select(F.slice("ids", 1, size - 1).alias("ids")).distinct(), "ids", "left_anti")
        cuts = self.cuts(alone)
        wanted = cuts.select("lang", F.explode("cuts").alias("c")).where(F.col("c.r").isNull()).select(
            "lang", F.col("c.rest").alias("phrase"), F.col("c.rest_ids").alias("ids")
        ).distinct()
        for batch in self.batches(wanted, "lang", "phrase", "ids"):
            trie = Trie([], [tuple(x) for x in batch["ids"].to_pylist()])
            rests = self.with_nodes(batch.select(["lang", "phrase"]), trie.wanted_nodes)
            self.known.append(
                materialise(counts_of(self.corpus, trie).join(rests, "node").select("lang", "phrase", "f"), "phrase-rests")
            )
        scored = self.cuts(cuts.select(*PHRASE))
        lowest = F.col("cuts")[0]
        scored = scored.select("lang", "phrase", "a", *(lowest[c].alias(c) for c in ("l", "r")), "n", lowest["score"].alias("score"))
        if self.best is not None:
            scored = scored.unionByName(self.best.drop("rank"))
        self.best = materialise(best_of(scored, self.top), "phrase-best")

    def cuts(self, phrases: DataFrame) -> DataFrame:
        """The phrases that may still be among the best, with their cuts as far as they are known."""
        cuts = self.with_least(cut_scores(phrases, reduce(DataFrame.unionByName, self.known)))
        # The first cut has the lowest score or bound.
        return materialise(cuts.where(F.col("cuts")[0]["score"] >= F.col("least")), "phrase-cuts")

    def run(self) -> DataFrame:
        after, mass = 0, self.size // PART
        while True:
            rows = self.frontier(after, mass)
            if not rows.num_rows:
                break
            after, mass = rows["ids"][-1].as_py()[0], mass * WIDER
            self.score(self.grown(rows))
        if self.best is None:
            return self.spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
        return self.best.select(*RESULT)


def collocations(docs: DataFrame, top: int = TOP, chunk: int = CHUNK, shared: int = SHARED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of 2 to 5 words.

    ``a`` is how often the phrase occurs, ``l`` and ``r`` the two parts of its lowest-scoring cut,
    ``n`` the language's words. A phrase that always stands inside a longer one is left out. Null
    texts are empty, a null language is ``und``. Every row counts, also if it repeats; texts of any
    length are read whole. Tables without a phrase that occurs ``LEAST`` times give no rows. Other
    columns aren't read.
    """
    return Search(docs, top, chunk, shared).run()
