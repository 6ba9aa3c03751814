"""Quality by nearest-neighbour voting: labelled documents near by in a latent-semantic space vote."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, StructField, StructType

from kvartal.session import materialise

# A document counts as good from this score on.
THRESHOLD = 0.3
# At most this many labelled documents of each class vote, drawn by a hash of their id; every
# document is scored, on its whole text.
SAMPLE = {1: 3000, 0: 1500}
# Terms of the latent space, those in most labelled documents first, and its dimensions.
TERMS = {"word": 1024, "shape": 1024, "bin": 64}
DIMENSIONS = 48
NEIGHBOURS = 15
# Similarities are raised to this power when they weight votes.
SHARPNESS = 8
# Documents whose products with all voters are computed at once.
BLOCK = 512

LETTER, CAPITAL, DIGIT = b"x", b"X", b"9"
# Bytes -> class of character: letters (all of UTF-8's multi-byte ones too), digits; the rest stays.
SHAPES = bytes(
    CAPITAL[0] if 65 <= b <= 90 else LETTER[0] if 97 <= b <= 122 or b >= 128 else DIGIT[0] if 48 <= b <= 57 else b
    for b in range(256)
)
# How finely shares are binned: how many words repeat the one before, how many triples repeat.
BINS = 8


def shapes(text: bytes) -> list[bytes]:
    """The words with each run of one class of character reduced to one: ``Ab,`` and ``Xyz,`` are ``Xx,``."""
    classes = np.frombuffer(text.translate(SHAPES), np.uint8)
    first = np.ones(len(classes), bool)
    first[1:] = classes[1:] != classes[:-1]
    return classes[first].tobytes().split()


def shares(words: list[bytes]) -> list[bytes]:
    """Two terms that say how much a text repeats itself."""
    n = len(words)
    if n < 4:
        return []
    same = sum(map(eq, words, words[1:])) / (n - 1)
    again = 1 - len(set(zip(words, words[1:], words[2:]))) / (n - 2)
    return [b"same:%d" % round(same * BINS), b"again:%d" % round(again * BINS)]


def streams(text: bytes) -> dict[str, list[bytes]]:
    words = text.lower().split()
    return {"word": words, "shape": shapes(text), "bin": shares(words)}


@dataclass
class Space:
    """A latent-semantic space: terms by kind, their weights, and the directions."""

    terms: dict[str, dict[bytes, int]]
    idf: np.ndarray
    directions: np.ndarray

    def weights(self, text: bytes) -> np.ndarray:
        return term_weights(streams(text), self.terms) * self.idf

    def vectors(self, texts: Iterable[bytes]) -> np.ndarray:
        """Unit vectors, or zero for texts without a known term."""
        found = []
        for text in texts:
            weights = self.weights(text)
            used = np.flatnonzero(weights)
            found.append(weights[used] @ self.directions[used])
        return unit(np.array(found, np.float32).reshape(-1, self.directions.shape[1]))


def term_weights(found: dict[str, list[bytes]], terms: dict[str, dict[bytes, int]]) -> np.ndarray:
    """Square roots of each term's share in its kind, so that a text's length doesn't count."""
    size = sum(map(len, terms.values()))
    weights = np.zeros(size, np.float32)
    for kind, known in terms.items():
        if words := found[kind]:
            ids = np.fromiter(map(known.get, words, repeat(size)), np.int64, len(words))
            weights += np.sqrt(np.bincount(ids, minlength=size + 1)[:size] / len(words))
    return weights


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.zeros_like(rows), where=size > 1e-12)


def fit(texts: Iterable[bytes]) -> tuple[Space, np.ndarray]:
    """The space of these texts by a truncated singular value decomposition, and their unit vectors."""
    found = [{kind: Counter(words) for kind, words in streams(text).items()} for text in texts]
    terms, at = {}, 0
    spread = {kind: Counter() for kind in TERMS}
    for counts in found:
        for kind, words in counts.items():
            spread[kind].update(words.keys())
    idf = []
    for kind, most in TERMS.items():
        chosen = sorted(((n, t) for t, n in spread[kind].items() if n > 1), key=lambda x: (-x[0], x[1]))[:most]
        terms[kind] = {t: at + i for i, (_, t) in enumerate(chosen)}
        at += len(chosen)
        idf += [np.log((1 + len(found)) / n) for n, _ in chosen]
    idf = np.array(idf, np.float32)
    matrix = np.zeros((len(found), at), np.float32)
    for row, counts in zip(matrix, found):
        for kind, known in terms.items():
            total = sum(counts[kind].values())
            for term, n in counts[kind].items():
                if (i := known.get(term)) is not None:
                    row[i] = np.sqrt(n / total)
    matrix = unit(matrix * idf)
    # The right singular vectors, from the terms' products: their number is bounded, and so is this.
    values, vectors = np.linalg.eigh((matrix.T @ matrix).astype(np.float64))
    top = np.argsort(-values)[: min(DIMENSIONS, at, len(found))]
    space = Space(terms, idf, vectors[:, top].astype(np.float32))
    return space, unit(matrix @ space.directions)


@dataclass
class Voters:
    """The space, with the labelled vectors, their labels and what each vote counts."""

    space: Space
    vectors: np.ndarray
    labels: np.ndarray
    weight: np.ndarray

    def scores(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Share of the nearest voters' weight with label 1, and the nearest one's similarity.

        A text that is like none of them gets the share of label 1 among all.
        """
        usual = float((self.weight * self.labels).sum() / self.weight.sum())
        score, best = np.full(len(texts), usual), np.zeros(len(texts))
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            cosines = self.space.vectors(texts[at : at + BLOCK]) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            close = np.maximum(np.take_along_axis(cosines, near, 1), 0)
            votes = close.astype(np.float64) ** SHARPNESS * self.weight[near]
            total = votes.sum(1)
            some = total > 1e-12
            here = slice(at, at + len(cosines))
            score[here][some] = ((votes * self.labels[near]).sum(1)[some] / total[some]).clip(0, 1)
            best[here] = close.max(1)
        return score, best


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def drawn(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """text, quality of a bounded sample of the labelled documents that are not held out, and
    how many labelled documents each class has.

    Ids are drawn before texts are fetched, so no other text moves. A document labelled twice is
    bad if any label says so; of rows with one id the smallest text votes.
    """
    marks = materialise(
        labels.where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi"),
        "quality-marks",
    )
    counts = {r["quality"]: r["n"] for r in marks.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    bad, good = (marks.where(F.col("quality") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE[y]) for y in (0, 1))
    sample = materialise(bad.unionByName(good), "quality-sample")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(sample), "doc_id"  # at most sum(SAMPLE) slim rows
    )
    return texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), counts


def train(docs: DataFrame, labels: DataFrame) -> Voters | None:
    """The voters, weighted back to their class's share of all labelled documents; None without labels.

    They are fitted where they are drawn to: at most sum(SAMPLE) documents, each reduced to
    counts of its terms before the next one is read.
    """
    rows, counts = drawn(docs, labels)
    if not counts:
        return None

    def fitted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The order of the sum is the ids', whatever the order of arrival.
        frame = pd.concat(list(frames)).sort_values("doc_id")
        space, vectors = fit(t.encode("utf-8", "replace") for t in frame["text"])
        labels = frame["quality"].to_numpy(np.int64)
        weight = np.array([counts[y] / (labels == y).sum() for y in labels.tolist()])
        yield pd.DataFrame({"model": [pickle.dumps(Voters(space, vectors, labels, weight))]})

    # One task fits: its rows are bounded by SAMPLE.
    model = rows.coalesce(1).mapInPandas(fitted, "model binary").collect()
    return pickle.loads(bytes(model[0]["model"]))


SCORES = [StructField("score", DoubleType()), StructField("nearest", FloatType())]


def with_scores(docs: DataFrame, voters: Voters | None) -> DataFrame:
    """Add ``SCORES`` to the rows; without voters every score is 0.5. Null texts are empty."""
    names = docs.columns
    # Bounded by SAMPLE, TERMS and DIMENSIONS: 2 MB.
    shared = docs.sparkSession.sparkContext.broadcast(voters)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = shared.value
        for batch in batches:
            texts = [(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(names.index("text"))]
            score, nearest = (np.full(len(texts), 0.5), np.zeros(len(texts))) if voters is None else voters.scores(texts)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64()), pa.array(nearest, pa.float32())],
                [*batch.schema.names, "score", "nearest"],
            )

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, *SCORES]))


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, nearest (similarity of the nearest voter) for every row.

    Only the text is scored. An empty or null text, and one that shares no term with a voter,
    scores as the share of label 1; 0.5 where nothing is labelled. With one class alone all
    scores are that class. Null ids are not held out; null labels are left out. Repeated rows get
    equal scores; an empty table gives no rows. Other columns, whatever their names, aren't read.
    """
    scored = with_scores(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"), "nearest",
    )
