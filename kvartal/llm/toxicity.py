"""Toxicity by multiple-instance learning: sentences scored from labels of whole documents."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from kvartal.session import materialise

# A document counts as toxic from this score on.
THRESHOLD = 0.7
# The model is fitted on at most this many labelled rows of each class, taken by a hash of
# their id; everything else covers all rows.
SAMPLE = {1: 1500, 0: 3000}
BUCKETS = 1 << 20
# A feature is used when its documents are toxic more often than chance explains (a likelihood
# ratio statistic); without this the rare words of toxic documents are learnt by heart.
EVIDENCE = 20.0
STEPS, RATE, DECAY = 80, 0.2, 1e-6
FIRST_BIAS = -6.0

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"\w+")
# Lengths of the beginnings and endings that are features of a longer word.
STARTS, ENDS = (3, 4, 5, 6), (3, 4, 5)


def tokens_of(sentence: str) -> list[str]:
    """Words of a lowered sentence: letters and digits; an underscore is none."""
    return WORD.findall(sentence.replace("_", " "))


def bucket(part: str) -> int:
    return zlib.crc32(part.encode("utf-8", "replace")) % BUCKETS


def features(word: str) -> list[int]:
    """Buckets of a word: the word, and its beginnings and endings, which survive inflection."""
    size = len(word)
    parts = ["=" + word]
    parts += ["^" + word[:k] for k in STARTS if k < size]
    parts += [word[-k:] + "$" for k in ENDS if k < size]
    return [bucket(p) for p in parts]


class Features:
    """The features of numbered words in one flat array."""

    def __init__(self, words: Iterable[str]):
        flat, sizes = array("i"), array("i")
        for word in words:
            found = features(word)
            flat.extend(found)
            sizes.append(len(found))
        self.sizes = np.array(sizes, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.used, column = np.unique(np.array(flat, np.int32), return_inverse=True)
        self.column = column.astype(np.int32)

    def of(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All features of ``words``, and for each the index of its word among them."""
        sizes = self.sizes[words]
        inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return self.column[np.repeat(self.first[words], sizes) + inside], np.repeat(np.arange(len(words)), sizes)


def _telling(documents: Iterable[np.ndarray], known: Features, toxic: np.ndarray) -> np.ndarray:
    """Which features stand in toxic documents more often than chance explains.

    ``documents``: each one's distinct words.
    """
    seen = {0: np.zeros(len(known.used)), 1: np.zeros(len(known.used))}
    for words, label in zip(documents, toxic.tolist()):
        seen[label][np.unique(known.of(words)[0])] += 1
    share, both = toxic.mean(), seen[0] + seen[1]

    def part(found, expected):
        return found * np.log(np.maximum(found, 1e-300) / np.maximum(expected, 1e-300))

    ratio = 2 * (part(seen[1], both * share) + part(seen[0], both * (1 - share)))
    return (ratio >= EVIDENCE) & (seen[1] > both * share)


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Feature weights and bias that maximise the documents' noisy-or likelihood.

    A sentence is toxic with probability sigmoid(bias + sum of its words' features); a
    document is toxic unless all its sentences are clean.
    """
    words: dict[str, int] = {}
    tokens, per_sentence, ends = array("i"), array("i"), [0]
    for text in texts:
        for sentence in SENTENCE.findall(text.lower()):
            if found := tokens_of(sentence):
                tokens.extend(words.setdefault(w, len(words)) for w in found)
                per_sentence.append(len(found))
        ends.append(len(tokens))
    known = Features(words)
    n_words = len(words)
    del words
    token = np.array(tokens, np.int32)
    telling = _telling((np.unique(token[x:y]) for x, y in zip(ends, ends[1:])), known, toxic)
    # Words without a telling feature add nothing: only the others' tokens are kept.
    column, word_of = known.of(np.arange(n_words))
    column, word_of = column[telling[column]], word_of[telling[column]]
    rich = np.bincount(word_of, minlength=n_words) > 0
    column = (np.cumsum(telling) - 1)[column]
    word_of = (np.cumsum(rich) - 1)[word_of]
    sizes = np.array(per_sentence, np.int64)
    kept = rich[token]
    sentence_of = np.repeat(np.arange(len(sizes)), sizes)[kept]
    document_of = np.searchsorted(ends, np.cumsum(sizes) - sizes, "right") - 1
    token = (np.cumsum(rich) - 1)[token[kept]]
    used, n_words = known.used[telling], int(rich.sum())
    theta, bias = np.zeros(len(used)), FIRST_BIAS
    moments = [np.zeros(len(used) + 1), np.zeros(len(used) + 1)]
    total = weight.sum()
    for step in range(1, STEPS + 1):
        by_word = np.bincount(word_of, theta[column], n_words)
        z = bias + np.bincount(sentence_of, by_word[token], len(sizes))
        clean = -np.bincount(document_of, np.logaddexp(0.0, z), len(texts))  # log P(all clean)
        p_clean = np.exp(clean)
        # How the loss moves with log P(all clean): toxic documents push it down, others up.
        pull = np.where(toxic == 1, p_clean / np.maximum(1 - p_clean, 1e-9), -1.0) * weight / total
        by_sentence = -pull[document_of] / (1 + np.exp(-np.clip(z, -50, 50)))
        of_word = np.bincount(token, by_sentence[sentence_of], n_words)
        gradient = np.bincount(column, of_word[word_of], len(used)) + DECAY * theta
        full = np.r_[gradient, by_sentence.sum()]
        moments[0] = 0.9 * moments[0] + 0.1 * full
        moments[1] = 0.99 * moments[1] + 0.01 * full**2
        move = RATE * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        theta, bias = theta - move[:-1], bias - move[-1]
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = theta
    return weights, float(bias)


def _fit_rows(frames: Iterator[pd.DataFrame], counts: dict[int, int]) -> Iterator[pd.DataFrame]:
    frame = pd.concat([pd.DataFrame({"text": [], "toxic": [], "_key": []}), *frames]).sort_values(["toxic", "_key"])
    toxic = frame["toxic"].to_numpy(np.int64)
    if len(set(toxic.tolist())) == 2:
        weight = np.where(toxic == 1, counts[1] / (toxic == 1).sum(), counts[0] / (toxic == 0).sum())
        weights, bias = fit(frame["text"].tolist(), toxic, weight)
        known = np.flatnonzero(np.abs(weights) > 1e-4)
        yield pd.DataFrame({"bucket": np.r_[-1, known], "weight": np.r_[bias, weights[known]]})


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def drawn(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, dict[int, int]] | None:
    """text, toxic, _key of a bounded sample of the labelled rows that are not held out, and
    the number of labelled documents of each class.

    Only labels of documents that are there count. Ids are drawn first and are few by their
    bound, so fetching their texts moves no other text; of these texts, each taken once however
    often a row repeats, at most ``SAMPLE`` of a class are drawn. None if either class has no
    labelled document.
    """
    marks = materialise(
        labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi"),
        "toxic-marks",
    )
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(counts) != {0, 1}:
        return None
    no, yes = (marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE[y]) for y in (0, 1))
    sample = materialise(no.unionByName(yes), "toxic-sample")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        F.broadcast(sample), "doc_id"  # at most sum(SAMPLE) slim rows
    )
    texts = materialise(texts.select("text", "toxic", F.xxhash64("doc_id", "text").alias("_key")), "toxic-texts")
    no, yes = (texts.where(F.col("toxic") == y).select("toxic", "_key").distinct().orderBy("_key").limit(SAMPLE[y]) for y in (0, 1))
    keys = materialise(no.unionByName(yes), "toxic-keys")
    return texts.join(F.broadcast(keys), ["toxic", "_key"]).dropDuplicates(["toxic", "_key"]), counts


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """The model, from a bounded sample of the labelled rows that are not held out.

    Classes are weighted back to their share of all labelled documents. Rows that label a
    document twice count as toxic if any does; null labels are left out. None if either class
    has no labelled document.
    """
    found = drawn(docs, labels)
    if found is None:
        return None
    rows, counts = found
    # One task fits: its rows are bounded by SAMPLE.
    model = rows.select("text", "toxic", "_key").coalesce(1).mapInPandas(
        lambda frames: _fit_rows(frames, counts), "bucket bigint, weight double"
    ).toPandas()
    if model.empty:
        return None
    weights = np.zeros(BUCKETS, np.float32)
    known = model[model["bucket"] >= 0]
    weights[known["bucket"].to_numpy()] = known["weight"].to_numpy()
    return weights, float(model.loc[model["bucket"] < 0, "weight"].iloc[0])


class Parts(dict):
    """Beginning or ending of a word -> weight of its feature, remembered for those met last."""

    HELD = 50_000

    def __init__(self, known: dict[int, float], before: str, after: str):
        super().__init__()
        self.known, self.before, self.after = known, before, after

    def __missing__(self, part: str) -> float:
        if len(self) >= self.HELD:
            self.clear()
        value = self[part] = self.known.get(bucket(self.before + part + self.after), 0.0)
        return value


class Scorer(dict):
    """Word -> summed feature weights, remembered for the words met last.

    Most words of a large corpus are rare, but their beginnings and endings are not, so a
    new word is mostly summed from remembered parts.
    """

    HELD = 100_000

    def __init__(self, model):
        super().__init__()
        weights, self.bias = model
        used = np.flatnonzero(weights)
        self.known = dict(zip(used.tolist(), weights[used].tolist()))
        self.starts, self.ends = Parts(self.known, "^", ""), Parts(self.known, "", "$")

    def __missing__(self, word: str) -> float:
        if len(self) >= self.HELD:
            self.clear()
        size, starts, ends = len(word), self.starts, self.ends
        value = self.known.get(bucket("=" + word), 0.0)
        for k in STARTS:
            if k < size:
                value += starts[word[:k]]
        for k in ENDS:
            if k < size:
                value += ends[word[-k:]]
        self[word] = value
        return value

    def sentences(self, text: str) -> Iterator[tuple[int, int, float]]:
        """Start, end and toxicity of every sentence that has words."""
        lowered = text.lower()
        if len(lowered) != len(text):  # a few letters grow when lowered; spans are the text's
            lowered = text
        for found in SENTENCE.finditer(lowered):
            if words := tokens_of(found[0].lower() if lowered is text else found[0]):
                z = self.bias + sum(map(self.__getitem__, words))
                yield found.start(), found.end(), 1 / (1 + math.exp(-min(max(z, -700), 700)))

    def document(self, text: str) -> tuple[float, int, int, float]:
        """Noisy-or score, and span and score of the worst sentence."""
        clean, worst = 0.0, (0, 0, 0.0)
        for start, end, p in self.sentences(text):
            clean += math.log1p(-min(p, 1 - 1e-12))
            if p > worst[2]:
                worst = (start, end, p)
        return (-math.expm1(clean), *worst)


SCORES = [
    StructField("score", DoubleType()), StructField("worst_start", IntegerType()),
    StructField("worst_end", IntegerType()), StructField("worst_score", DoubleType()),
]


def with_scores(docs: DataFrame, model) -> DataFrame:
    """Add ``SCORES`` to the rows; without a model every score is 0.5. Null texts are empty."""
    names = docs.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if model is None else Scorer(model)
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(names.index("text")))
            found = [scorer.document(t) if scorer is not None else (0.5, 0, 0, 0.0) for t in texts]
            score, start, end, worst = zip(*found) if found else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score, pa.float64()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(worst, pa.float64())],
                [*batch.schema.names, "score", "worst_start", "worst_end", "worst_score"],
            )

    return docs.mapInArrow(scored, StructType([*docs.schema.fields, *SCORES]))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, and the worst sentence's span and score, for every row.

    Only the text is scored. An empty or null text has no sentence and scores 0 (0.5 where
    there is no model for want of labels). Null ids are not held out. Repeated rows get equal
    scores; an empty table gives no rows.
    """
    scored = with_scores(docs.select("doc_id", "text"), train(docs, labels))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "worst_start", "worst_end", "worst_score",
    )


def offending_sentences(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """doc_id, start, end, sentence, score of all sentences that are likely toxic by themselves."""
    model = train(docs, labels)

    def located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            rows = [
                (d, start, end, t[start:end], p)
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for start, end, p in scorer.sentences(t or "") if p >= at_least
            ]
            yield pa.RecordBatch.from_pylist(
                [dict(zip(("doc_id", "start", "end", "sentence", "score"), r)) for r in rows],
                pa.schema([("doc_id", batch.schema.field(0).type), ("start", pa.int32()), ("end", pa.int32()), ("sentence", pa.string()), ("score", pa.float64())]),
            )

    kind = dict(docs.dtypes)["doc_id"]
    if model is None:
        return docs.sparkSession.createDataFrame([], f"doc_id {kind}, start int, end int, sentence string, score double")
    return docs.select("doc_id", "text").mapInArrow(located, f"doc_id {kind}, start int, end int, sentence string, score double")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows scored below the threshold, with all their columns, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest"), "text")
    clean = with_scores(packed, train(docs, labels)).where(F.col("score") < threshold)
    return clean.select(*("text" if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns))
