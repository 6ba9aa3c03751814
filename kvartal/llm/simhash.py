"""Near duplicates by SimHash and a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kvartal.llm.components import components, roots
from kvartal.operators.joins import lookup_join
from kvartal.session import materialise

SHINGLE = 4
MAX_BITS = 4
SEED = 42
# The fingerprint's bits in six fields; four differing bits leave at least two of them whole,
# so every linked pair agrees on one of the fifteen pairs of fields.
FIELDS = (11, 11, 11, 11, 10, 10)
# Fingerprints under one node of the index, and nodes compared at a time.
LEAF = 32
BATCH = 2048
# Rows of one tree; a longer partition is cut, and the cuts are linked afterwards.
TREE_ROWS = 1 << 16

U = np.uint64


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the shingles' hashes; no words give zero."""
    words = text.lower().split()  # for bytes: A-Z, and the six ASCII white-space characters
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    n = max(1, len(words) - shingle + 1)
    first, last = starts[:n].tolist(), ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):  # a very long text is counted in pieces
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + (1 << 16)], last[at : at + (1 << 16)])]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    set_bits = np.flatnonzero(2 * ones > n)
    return sum(1 << int(i) for i in set_bits)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [fingerprint(t.as_py() or b"") for t in batch.column("text")]
        signed = pa.array(np.array(values, "u8").view("i8"))
        yield pa.RecordBatch.from_arrays([*batch.columns, signed], [*batch.schema.names, "_print"])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """Add ``_print``, the fingerprint as a signed long; null texts count as empty."""
    sent = docs.withColumn("text", F.col("text").cast("binary"))
    schema = StructType([*sent.schema.fields, StructField("_print", LongType())])
    return sent.mapInArrow(_fingerprints, schema).withColumn("text", F.col("text").cast("string"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each 64-bit code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> U(shift)
    return rank


def field_pairs() -> list[tuple[list[tuple[int, int]], int]]:
    """For each pair of fields: the order of (low bit, width) that puts it on top, and its width."""
    low = np.cumsum((0, *FIELDS))[:-1]
    every = [(int(a), w) for a, w in zip(low, FIELDS)]
    return [
        ([every[i], every[j], *(f for k, f in enumerate(every) if k not in (i, j))], FIELDS[i] + FIELDS[j])
        for i in range(len(FIELDS)) for j in range(i + 1, len(FIELDS))
    ]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each fingerprint once for each pair of fields, with its Gray rank when that pair is on top."""
    for batch in batches:
        prints = batch.column("_print").to_numpy().view("u8")
        for no, (order, width) in enumerate(field_pairs()):
            code = np.zeros(len(prints), U)
            for low, bits in order:
                code = (code << U(bits)) | ((prints >> U(low)) & U((1 << bits) - 1))
            rank = gray_rank(code)
            key = ((rank >> U(64 - width)) | (U(no) << U(32))).view("i8")
            yield pa.RecordBatch.from_arrays(
                [pa.array(key), pa.array((rank ^ U(1 << 63)).view("i8")), pa.array(prints.view("i8"))],
                ["key", "rank", "code"],
            )


class Node:
    """Groups of consecutive codes in Gray order, each with the bits its members share."""

    def __init__(self, codes: np.ndarray, keys: np.ndarray, leaf: int = LEAF):
        starts = np.arange(0, len(codes), leaf)
        self.starts, self.ends = starts, np.minimum(starts + leaf, len(codes))
        both, some = np.bitwise_and.reduceat(codes, starts), np.bitwise_or.reduceat(codes, starts)
        self.mask, self.value = ~(both ^ some), both
        self.first, self.last = keys[starts], keys[self.ends - 1]


def linked(codes: np.ndarray, keys: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Root (smallest index) of each code, sorted by key and Gray rank, under links within a key.

    Group pairs that share a key are tried in order of distance. One is dropped whole when the
    bits both groups share differ too often, or when all its members hang together already.
    """
    n, label = len(codes), np.arange(len(codes))
    tree = Node(codes, keys)
    # Sorted keys: the groups that meet group g's last key are g, g + 1, ... up to `until`.
    until = np.searchsorted(tree.first, tree.last, "right")
    offsets = np.arange(LEAF)
    distance = 0
    active = np.arange(len(tree.starts))
    while len(active):
        for at in range(0, len(active), BATCH):
            a = active[at : at + BATCH]
            b = a + distance
            apart = np.bitwise_count((tree.value[a] ^ tree.value[b]) & tree.mask[a] & tree.mask[b])
            a, b = a[apart <= max_bits], b[apart <= max_bits]
            if distance:
                ends = [label[tree.starts[x]] for x in (a, b)]
                whole = ends[0] == ends[1]
                if whole.any():
                    low, high = (f.reduceat(label, tree.starts) for f in (np.minimum, np.maximum))
                    done = (low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b])
                    a, b = a[~done], b[~done]
            if not len(a):
                continue
            i, j = tree.starts[a][:, None] + offsets, tree.starts[b][:, None] + offsets
            x, y = np.minimum(i, n - 1), np.minimum(j, n - 1)
            near = np.bitwise_count(codes[x][:, :, None] ^ codes[y][:, None, :]) <= max_bits
            near &= keys[x][:, :, None] == keys[y][:, None, :]
            near &= (i < n)[:, :, None] & (j < n)[:, None, :]
            if not distance:
                near &= offsets[:, None] < offsets
            g, p, q = np.nonzero(near)
            label = roots(n, x[g, p], y[g, q], label)
        distance += 1
        active = active[active + distance < until[active]]
    return label


EDGE = "kind string, a bigint, b bigint, key bigint, tree bigint, value bigint, mask bigint, members array<bigint>"
_SCHEMA = pa.schema([
    ("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("tree", pa.int64()),
    ("value", pa.int64()), ("mask", pa.int64()), ("members", pa.list_(pa.int64())),
])


def _tree_rows(keys: np.ndarray, codes: np.ndarray, tree: int) -> Iterator[pa.RecordBatch]:
    """The links of one tree, and the groups of its first and last key for the trees beside it."""
    label = linked(codes, keys)
    joined = np.flatnonzero(label != np.arange(len(codes)))
    none = pa.nulls(len(joined))
    yield pa.RecordBatch.from_arrays(
        [pa.array(["edge"] * len(joined), pa.string()), pa.array(codes[joined].view("i8")), pa.array(codes[label[joined]].view("i8")),
         *(none.cast(t) for t in _SCHEMA.types[3:])], schema=_SCHEMA,
    )
    for key in {int(keys[0]), int(keys[-1])}:
        own = codes[keys == key]
        node = Node(own, np.full(len(own), key))
        size = len(node.starts)
        members = pa.ListArray.from_arrays(
            pa.array(np.r_[node.starts, len(own)], pa.int32()), pa.array(own.view("i8"))
        )
        yield pa.RecordBatch.from_arrays(
            [pa.array(["node"] * size), pa.nulls(size, pa.int64()), pa.nulls(size, pa.int64()), pa.array([key] * size, pa.int64()),
             pa.array([tree] * size, pa.int64()), pa.array(node.value.view("i8")), pa.array(node.mask.view("i8")), members],
            schema=_SCHEMA,
        )


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Build and join the index of one sorted partition, tree after tree."""
    held, rows, part, trees = [], 0, None, 0

    def built():
        t = pa.Table.from_batches(held)
        return _tree_rows(
            t["key"].to_numpy(), t["code"].to_numpy().view("u8"), (part << 33) | trees
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column("part")[0].as_py()
        held.append(batch)
        rows += batch.num_rows
        if rows >= TREE_ROWS:
            yield from built()
            held, rows, trees = [], 0, trees + 1
    if held:
        yield from built()


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two groups of different trees, as a forest: one edge for each that hangs on."""
    for batch in batches:
        ends = ([], [])
        for x, y in zip(batch.column("members").to_pylist(), batch.column("others").to_pylist()):
            codes = np.array(x + y, "i8").view("u8")
            near = np.bitwise_count(codes[: len(x), None] ^ codes[None, len(x) :]) <= MAX_BITS
            p, q = np.nonzero(near)
            label = roots(len(codes), p, q + len(x))
            hung = np.flatnonzero(label != np.arange(len(codes)))
            ends[0].extend(codes[hung].view("i8").tolist())
            ends[1].extend(codes[label[hung]].view("i8").tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ends[0], pa.int64()), pa.array(ends[1], pa.int64())], ["a", "b"])


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints ``_print`` as all links would.

    Sorted by field pair and Gray rank over the cluster, a key with any share of the
    fingerprints is spread over as many partitions as it fills. Each partition joins its own
    tree; only groups of keys that cross a tree's border are compared with other trees, and
    only where the bits that both groups share allow it.
    """
    entries = prints.mapInArrow(_entries, "key bigint, rank bigint, code bigint")
    ordered = (
        entries.repartitionByRange("key", "rank").sortWithinPartitions("key", "rank")
        .withColumn("part", F.spark_partition_id()).select("key", "code", "part")
    )
    built = materialise(ordered.mapInArrow(_trees, EDGE), "gray-trees")
    nodes = built.where("kind = 'node'")
    other = nodes.select(
        "key", F.col("tree").alias("_tree"), F.col("value").alias("_value"),
        F.col("mask").alias("_mask"), F.col("members").alias("others"),
    )
    shared = F.col("mask").bitwiseAND(F.col("_mask"))
    pairs = nodes.join(
        other,
        (nodes["key"] == other["key"]) & (F.col("tree") < F.col("_tree"))
        & (F.bit_count(F.col("value").bitwiseXOR(F.col("_value")).bitwiseAND(shared)) <= MAX_BITS),
    ).select("members", "others")
    return built.where("kind = 'edge'").select("a", "b").unionByName(pairs.mapInArrow(_across, "a bigint, b bigint"))


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows with ``_print`` and ``_doc`` get ``_component``, the smallest _doc of all they reach."""
    prints = rows.groupBy("_print").agg(F.min("_doc").alias("_least"))
    prints = materialise(prints, "fingerprints")
    found = components(fingerprint_links(prints.select("_print")))
    rooted = lookup_join(prints, found.select(F.col("node").alias("_print"), "root"), ["_print"])
    rooted = rooted.withColumn("_root", F.coalesce("root", "_print"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("_component"))
    smallest = lookup_join(rooted, least, ["_root"]).select("_print", "_component")
    return lookup_join(rows, smallest, ["_print"])


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row.

    Words are split at ASCII white space after lowering A-Z; fewer than four make one shingle,
    none the fingerprint zero, which links like any other (null texts too). Null ids never name a
    component unless it has no other. Rows that repeat fall into one component. An empty
    table gives no rows. Only doc_id and text are read.
    """
    rows = materialise(
        with_fingerprint(docs.select(F.col("doc_id").alias("_doc"), "text")).select("_doc", "_print"), "simhash"
    )
    return _grouped(rows).select(
        F.col("_doc").alias("doc_id"),
        F.lower(F.lpad(F.hex("_print"), 16, "0")).alias("fingerprint"),
        F.col("_component").alias("component_id"),
    )


def drop_near(docs: DataFrame) -> DataFrame:
    """The rows whose doc_id names their component, with all their columns, whatever their names.

    Rows that share the smallest id of a component all stay, as do those of a component
    that has no id at all.
    """
    rest = [F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("_rest")]
    rows = materialise(with_fingerprint(docs.select(F.col("doc_id").alias("_doc"), "text", *rest)), "simhash")
    slim = _grouped(rows.select("_doc", "_print"))
    kept = slim.where("_component <=> _doc").select("_doc", "_print").distinct()
    keyed = F.coalesce(F.col("_doc").cast("string"), F.lit("null"))
    return (
        lookup_join(
            rows.withColumn("_key", keyed),
            kept.select(keyed.alias("_key"), "_print", F.lit(True).alias("_kept")), ["_key", "_print"],
        )
        .where("_kept")
        .select(*("text" if c == "text" else F.col(f"_rest.`{c}`").alias(c) for c in docs.columns))
    )
