"""Ranked lexical search by the Best Position Algorithm over impact-ordered lists.

Documents are indexed in shards: each holds, for every term asked for, its documents by falling
impact. A shard answers an item by itself, with weights that come from all documents, so its ten
best are candidates for the item's ten best and nothing else is needed from it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvartal.llm.common import lower_ascii
from kvartal.session import materialise

TOP = 10
# Postings of a shard: what a task holds at once.
SHARD = 2_000_000
# Terms of the items that are looked for at once, about; more items go in further blocks.
BLOCK = 500_000
# Positions of each list that are read at once at first; then twice as many each time.
DEPTH = 16

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# Bytes of a text as terms see them: A-Z lowered, digits, letters and multi-byte characters kept, the rest a space.
TERM_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term: distinct terms of the items; rows with one item_id are one item."""
    terms = F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(F.array_distinct(terms)).alias("term")).distinct()


def counted(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n, ids, tfs: each document's length in terms and, of the terms asked for, places in
    ``terms`` and occurrences."""
    shared = docs.sparkSession.sparkContext.broadcast({t.encode(): i for i, t in enumerate(terms)})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            lengths, ids, tfs, ends = [], [], [], [0]
            for text in batch.column(1):
                words = text.as_buffer().to_pybytes().translate(TERM_BYTES).split() if text.is_valid else []
                found = np.fromiter(map(known.get, words, repeat(-1)), np.int32, len(words))
                of, tf = np.unique(found[found >= 0], return_counts=True)
                lengths.append(len(words))
                ids.append(of)
                tfs.append(tf.astype(np.int32))
                ends.append(ends[-1] + len(of))
            ends = pa.array(ends, pa.int32())
            lists = (pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *x]))) for x in (ids, tfs))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], ["doc_id", "n", "ids", "tfs"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, n bigint, ids array<int>, tfs array<int>")


def weights(postings: DataFrame, n_docs: int, n_terms: int) -> tuple[np.ndarray, int]:
    """The weight of each term, from the number of documents that hold it, and the number of postings."""

    def holding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "df"])

    counts = postings.select("ids").mapInArrow(holding, "id bigint, df bigint").groupBy("id").agg(F.sum("df").alias("df"))
    df = np.zeros(n_terms, np.int64)
    for row in counts.collect():  # a row per term of the block
        df[row["id"]] = row["df"]
    return np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1))).astype(np.int64), int(df.sum())


class Shard:
    """Impact lists of some documents: by term and document for direct access, by term and rank in order."""

    def __init__(self, lengths: np.ndarray, sizes: np.ndarray, ids: np.ndarray, tfs: np.ndarray, weight: np.ndarray, n_docs: int, n_all: int):
        m = 100 - 90 + (90 * lengths * n_docs) // n_all
        self.n = len(lengths)
        doc = np.repeat(np.arange(self.n), sizes)
        tf = tfs.astype(np.int64)
        impact = weight[ids] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
        used = impact > 0  # a term that weighs nothing has no list
        doc, impact, term = doc[used], impact[used], ids[used].astype(np.int64)
        order = np.argsort(term * self.n + doc)
        self.key, self.impact = (term * self.n + doc)[order], impact[order]
        starts = np.searchsorted(self.key, np.arange(len(weight) + 1) * self.n)
        self.start, self.size = starts[:-1], np.diff(starts)
        # Lists by falling impact, equal ones by document; and the place of each posting there.
        ranked = np.lexsort((self.key, -self.impact, self.key // self.n))
        self.listed = ranked
        self.place = np.empty(len(ranked), np.int64)
        self.place[ranked] = np.arange(len(ranked))

    def best(self, terms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents that can be among the k best, by the Best Position Algorithm.

        A list's best position is the last one before its first unseen one, whether a position was
        seen in order or by direct access. No unseen document can score more than the sum of the
        impacts at the best positions; the search ends when that is strictly below the kth score,
        so that documents with equal scores are all seen.
        """
        terms = terms[self.size[terms] > 0]
        start, size = self.start[terms], self.size[terms]
        seen = [np.zeros(s + 1, bool) for s in size.tolist()]  # the last one stays False
        best = np.zeros(len(terms), np.int64)  # how many positions are seen without a gap
        met = np.zeros(self.n, bool)
        docs, scores, depth = [], [], DEPTH
        while (open_ := np.flatnonzero(best < size)).size:
            # Read on behind each best position.
            reads = [self.listed[start[i] + best[i] : start[i] + min(best[i] + depth, size[i])] for i in open_]
            found = np.unique(self.key[np.concatenate(reads)] % self.n)
            found = found[~met[found]]
            met[found] = True
            # Direct access to these documents in all lists.
            wanted = (terms[:, None] * self.n + found).ravel()
            at = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            hit = self.key[at] == wanted
            scores.append(np.where(hit, self.impact[at], 0).reshape(len(terms), -1).sum(0))
            docs.append(found)
            hit, place = hit.reshape(len(terms), -1), self.place[at].reshape(len(terms), -1)
            for i in open_:
                seen[i][place[i][hit[i]] - start[i]] = True
                best[i] += int(np.argmin(seen[i][best[i] :]))
            last = np.where(best < size, self.impact[self.listed[start + best - 1]], 0)
            if sum(map(len, scores)) >= k:
                kth = np.partition(np.concatenate(scores), -k)[-k]
                if last.sum() < kth:
                    break
            depth *= 2
        if not docs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, scores = np.concatenate(docs), np.concatenate(scores)
        if len(scores) > k:
            good = scores >= np.partition(scores, -k)[-k]
            docs, scores = docs[good], scores[good]
        return docs, scores


def _shards(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """doc_ids, lengths, sizes, ids and tfs of consecutive documents with about ``most`` postings."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch.column(2).flatten())
        if n >= most:
            yield _joined(held)
            held, n = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple:
    docs, lengths, ids, tfs = (pa.concat_arrays([b.column(k) for b in held]) for k in range(4))
    return docs.to_pylist(), lengths.to_numpy(), np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy(), tfs.flatten().to_numpy()


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` best documents with a score above 0.

    Every row of ``docs`` is a document of its own, also if ids or texts repeat; a null text has
    no terms, and null ids come after others of the same score. Rows of ``items`` with one
    item_id are one item; an item with no terms, or with none that a document holds, has no
    rows. Empty tables give no rows. Other columns aren't read.
    """
    terms = materialise(item_terms(items), "search-terms")
    # Items go to blocks by a hash, so that each block has about ``block`` terms.
    n = max(1, -(-terms.count() // block))
    found = [
        _search_block(docs, terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b), top, shard) for b in range(n)
    ]
    return reduce(DataFrame.unionByName, found)


def _search_block(docs: DataFrame, terms: DataFrame, top: int, shard: int) -> DataFrame:
    spark = docs.sparkSession
    asked = terms.groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms")).toArrow()
    item_type, lists = asked.schema.field("item_id").type, asked["terms"].to_pylist()
    known = {t: i for i, t in enumerate(sorted({t for x in lists for t in x}))}
    postings = materialise(counted(docs, list(known)), "search-postings")
    totals = postings.agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"),
    ).first()
    weight, n_postings = weights(postings, totals["docs"], len(known))
    queries = [(i, np.array([known[t] for t in x], np.int64)) for i, x in zip(asked["item_id"].to_pylist(), lists)]
    # Bounded by BLOCK terms and the longest item.
    shared = spark.sparkContext.broadcast((weight, queries))
    n_docs, n_all = totals["docs"], totals["terms"]

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, queries = shared.value
        for doc_ids, lengths, sizes, ids, tfs in _shards(batches, shard):
            if not len(ids):
                continue
            index = Shard(lengths, sizes, ids, tfs, weight, n_docs, n_all)
            item, doc, score = [], [], []
            for item_id, terms in queries:
                places, scores = index.best(terms, top)
                near = heapq.nsmallest(
                    top, ((-s, doc_ids[p] is None, doc_ids[p]) for p, s in zip(places.tolist(), scores.tolist()))
                )
                item += [item_id] * len(near)
                doc += [d for _, _, d in near]
                score += [-s for s, _, _ in near]
            yield pa.RecordBatch.from_arrays(
                [pa.array(item, item_type), pa.array(doc, doc_type), pa.array(score, pa.int64())], ["item_id", "doc_id", "score"]
            )

    doc_type = postings.limit(0).toArrow().schema.field("doc_id").type
    item_kind, doc_kind = dict(terms.dtypes)["item_id"], dict(docs.dtypes)["doc_id"]
    # Small partitions are read together, so that shards are as long as they may be.
    tasks = max(1, -(-n_postings // shard))
    near = postings.coalesce(tasks).mapInArrow(answer, f"item_id {item_kind}, doc_id {doc_kind}, score bigint")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return (
        near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
    )
