"""Repeated passages by suffix arrays of shards that hold what may repeat."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kvartal.operators.joins import lookup_join
from kvartal.session import discard, materialise

# Bytes of a string that must not start at two places.
LENGTH = 400
# Anchors are the least of this many neighbouring grams of GRAM bytes.
WINDOW, GRAM = 128, 8
# Bytes after an anchor that every string with this anchor has.
COMMON = LENGTH - WINDOW + 1
# Bytes scanned at a time, symbols of one shard's suffix array, ranges of a shard's digests.
CHUNK, SHARD, RANGES = 1 << 20, 1 << 21, 256

# Runs that repeat every few bytes are settled where they are met.
PERIODS = (1, 2, 3, 4, 6, 8)
# Symbols that a compared context has, about; sets the number of shards.
SYMBOLS = 160

U = np.uint64
POSITION = U((1 << 24) - 1)


class Rolling:
    """64-bit hashes of any substring, from sums of random byte values times powers of an odd base."""

    def __init__(self, seed: int, size: int):
        random = np.random.default_rng(seed)
        self.values = random.integers(0, 1 << 63, 256, np.uint64) * U(2) + U(1)
        base = U(int(random.integers(1 << 40, 1 << 62)) | 1)
        inverse = U(pow(int(base), -1, 1 << 64))
        self.power = np.cumprod(np.r_[U(1), np.full(size, base)])
        self.back = np.cumprod(np.r_[U(1), np.full(size, inverse)])

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.r_[U(0), np.cumsum(self.values[data] * self.power[: len(data)])]

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        found = (sums[end] - sums[start]) * self.back[start]
        found ^= found >> U(31)
        found *= U(0x9E3779B97F4A7C15)
        return found ^ (found >> U(29))


def periodic_runs(data: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, end, period) of runs that repeat every ``period`` bytes for a string and more.

    Every string in such a run starts again one period on or back. No run goes on behind one of ``ends``.
    """
    found, half = [], LENGTH // 2
    for period in PERIODS:
        same = data[:-period] == data[period:]
        crossing = (ends[:-1, None] - np.arange(1, period + 1)).ravel()
        same[crossing[crossing < len(same)]] = False
        # A run of LENGTH equalities fills a block of half of that.
        blocks = same[: len(same) // half * half].reshape(-1, half).all(1)
        if blocks.any():
            edges = np.flatnonzero(np.diff(np.r_[False, same, False].view(np.int8)))
            found += [(a, b + period, period) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= LENGTH]
    return found


def anchors(data: np.ndarray, starts: np.ndarray, key: Rolling, context: Rolling) -> tuple[np.ndarray, ...]:
    """(anchor, first start, last start, key, context) for the strings at ``starts``.

    A start's anchor is the least gram of the WINDOW next ones, the first of equals, so equal
    strings have it at the same place. Starts that share it are neighbours. ``key`` hashes the
    bytes that all their strings have after it, ``context`` all bytes of all their strings.
    """
    n = len(data) - GRAM + 1
    grams = np.zeros(n, U)
    for j in range(GRAM):
        grams |= data[j : j + n].astype(U) << U(8 * j)
    grams *= U(0xD6E8FEB86659FD93)
    grams ^= grams >> U(32)
    grams *= U(0xD6E8FEB86659FD93)
    least = (grams & ~POSITION) | np.arange(n, dtype=U)
    width = 1
    while width < WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    anchor = (least[starts] & POSITION).astype(np.int64)
    new = np.r_[True, (np.diff(anchor) != 0) | (np.diff(starts) != 1)]
    at = np.flatnonzero(new)
    anchor, low, high = anchor[at], starts[at], starts[np.r_[at[1:] - 1, len(starts) - 1]]
    keys = key.of(key.sums(data), anchor, anchor + COMMON)
    contexts = context.of(context.sums(data), low, high + LENGTH)
    shape = ((anchor - low) * WINDOW + (high - low)).astype(U)
    contexts = (contexts ^ (shape + U(1)) * U(0xBF58476D1CE4E5B9)) * U(0x94D049BB133111EB)
    return anchor, low, high, keys, contexts ^ (contexts >> U(31))


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, offset in its text, bytes) of about CHUNK bytes; long texts overlap."""
    held, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text) - LENGTH + 1, CHUNK):
            piece = text[at : at + CHUNK + LENGTH - 1]
            held.append((row, at, piece))
            size += len(piece)
            if size >= CHUNK:
                yield held
                held, size = [], 0
    if held:
        yield held


# Rows with this shape are periodic runs: all strings that start from ``place`` to ``key`` repeat.
RUN = -1
ANCHORS = "_a bigint, _b int, place bigint, shape int, key bigint, context bigint"


def _anchor_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size = 2 * CHUNK + 2 * LENGTH
    key, context = Rolling(1, size), Rolling(2, size)
    for batch in batches:
        a, b = (batch.column(c).to_numpy() for c in ("_a", "_b"))
        for pieces in _pieces([t or b"" for t in batch.column("bytes").to_pylist()]):
            data = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
            ends = np.cumsum([len(p) for _, _, p in pieces])
            begins = ends - [len(p) for _, _, p in pieces]
            wanted = np.zeros(len(data), bool)
            for x, y in zip(begins.tolist(), ends.tolist()):
                wanted[x : y - LENGTH + 1] = True
            runs = periodic_runs(data, ends)
            for x, y, period in runs:
                # What the run holds starts in its first period: the rest is the same again.
                wanted[x + period : y - LENGTH + 1] = False
            place, low, high, keys, contexts = anchors(data, np.flatnonzero(wanted), key, context)
            x, y = (np.array(c, np.int64) for c in (list(zip(*runs))[:2] if runs else ([], [])))
            at = np.r_[place, x]
            piece = np.searchsorted(ends, at, "right")
            row = np.array([r for r, _, _ in pieces])[piece]
            shift = np.array([o for _, o, _ in pieces])[piece] - begins[piece]
            shape = np.r_[(place - low) * WINDOW + (high - low), np.full(len(x), RUN)]
            last = y - LENGTH + shift[len(place) :]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a[row]), pa.array(b[row]), pa.array(at + shift), pa.array(shape.astype("i4")),
                 pa.array(np.r_[keys.view("i8"), last]), pa.array(np.r_[contexts.view("i8"), np.zeros(len(x), "i8")])],
                ["_a", "_b", "place", "shape", "key", "context"],
            )


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of all suffixes of an integer text, by Larsson-Sadakane refinement.

    Sorted first by four symbols; then, doubling the depth, only groups of suffixes that are
    still equal are sorted anew, by the rank of what follows at that depth.
    """
    n = len(text)
    bits = U(max(1, int(text.max(initial=1)).bit_length() + 1))
    padded = np.r_[text.astype(U) + U(1), np.zeros(4, U)]
    code = np.zeros(n, U)
    for j in range(4):
        code = (code << bits) | padded[j : j + n]
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    rank = np.empty(n, np.int64)
    sizes = np.diff(np.r_[first, n])
    rank[order] = np.repeat(first, sizes)
    open_ = np.flatnonzero(np.repeat(sizes > 1, sizes))  # places of unsorted groups
    depth = 4
    while len(open_):
        suffix = order[open_]
        after = suffix + depth
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        both = rank[suffix] * (n + 1) + follow
        sorted_ = np.argsort(both, kind="stable")
        suffix, both = suffix[sorted_], both[sorted_]
        order[open_] = suffix
        first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
        sizes = np.diff(np.r_[first, len(both)])
        rank[suffix] = np.repeat(open_[first], sizes)
        open_ = open_[np.repeat(sizes > 1, sizes)]
        depth *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(length in common with the suffix before it in ``order``, that suffix), by text position.

    Kasai's scan: one position on, the common length falls by one at most. All strings, which
    begin at ``starts``, are scanned side by side. Lengths stop at ``most``.
    """
    n = len(text)
    padded = np.r_[text, -1]
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    lengths = np.diff(np.r_[starts, n])
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by_length], lengths[by_length]
    common, now = np.zeros(n, np.int32), np.zeros(len(starts), np.int64)
    for t in range(int(lengths.max(initial=0))):
        alive = int(np.searchsorted(-lengths, -t, "left"))  # lengths over t
        at = starts[:alive] + t
        other, now = before[at], np.maximum(now[:alive] - 1, 0)
        now[other < 0] = 0
        todo = np.flatnonzero((other >= 0) & (now < most))
        while len(todo):
            x, y = at[todo] + now[todo], other[todo] + now[todo]
            same = (x < n) & (y < n) & (padded[np.minimum(x, n)] == padded[np.minimum(y, n)])
            todo = todo[same]
            now[todo] += 1
            todo = todo[now[todo] < most]
        common[at] = now
    return common, before


FOUND = "kind string, _a bigint, _b int, low bigint, high bigint, key bigint, digests int, run binary"
_FOUND = pa.schema([
    ("kind", pa.string()), ("_a", pa.int64()), ("_b", pa.int32()), ("low", pa.int64()), ("high", pa.int64()),
    ("key", pa.int64()), ("digests", pa.int32()), ("run", pa.binary()),
])
# A start at a shard's border, as it stands in a sorted run of them.
BORDER = np.dtype([("digest", "<u8"), ("a", "<i8"), ("low", "<i8"), ("b", "<i4"), ("wanted", "<i4")])


def _runs_of(flags: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of set flags within a group."""
    at = np.flatnonzero(flags)
    if not len(at):
        return at, at
    new = np.r_[True, (np.diff(at) != 1) | (np.diff(group[at]) != 0)]
    first = np.flatnonzero(new)
    return at[first], at[np.r_[first[1:] - 1, len(at) - 1]]


def _shard(table: pa.Table, rolling: Rolling) -> Iterator[pa.RecordBatch]:
    """Repeated starts of one shard's asking contexts, and what shards beside it must know.

    A context is its left bytes, one symbol for the bytes that all of its key have in common,
    and its right bytes; a string of LENGTH bytes is one of WINDOW symbols there.
    """
    keys, key_no = np.unique(table["key"].to_numpy(), return_inverse=True)
    left, right = table["left"].to_pylist(), table["right"].to_pylist()
    low, asks = table["low"].to_numpy(), table["asks"].to_numpy(zero_copy_only=False)
    a, b = table["_a"].to_numpy(), table["_b"].to_numpy()
    data = np.frombuffer(b"".join(x + b"\0" + y + b"\0" for x, y in zip(left, right)), np.uint8)
    sizes = np.array([len(x) + len(y) + 2 for x, y in zip(left, right)])
    starts = np.cumsum(sizes) - sizes
    text = data.astype(np.int64) + 1
    text[starts + [len(x) for x in left]] = 257 + key_no
    text[starts + sizes - 1] = 0
    order = suffix_array(text)
    common, before = common_prefixes(text, order, starts, WINDOW)
    repeated = np.zeros(len(text), bool)
    long = np.flatnonzero(common >= WINDOW)
    repeated[long] = repeated[before[long]] = True
    owner = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.arange(len(text)) - starts[owner]
    is_start = inside <= (sizes - 1 - WINDOW)[owner]
    first, last = _runs_of(repeated & is_start & asks[owner], owner)
    own = owner[first]
    yield _found("run", a[own], b[own], low[own] + inside[first], low[own] + inside[last])
    edge = np.isin(key_no, (key_no[0], key_no[-1]))
    at = np.flatnonzero(is_start & edge[owner])
    sums = rolling.sums(data)
    digest = rolling.of(sums, at, at + WINDOW).view("i8")
    own = owner[at]
    wanted = asks[own] & ~repeated[at]
    # Of starts that need no answer, one for each digest tells the other shards of it.
    _, one = np.unique(np.c_[digest, key_no[own]], axis=0, return_index=True)
    told = wanted.copy()
    told[one] = True
    run = np.empty(int(told.sum()), BORDER)
    run["digest"], run["a"], run["b"] = digest[told].view("u8"), a[own[told]], b[own[told]]
    run["low"], run["wanted"] = low[own[told]] + inside[at[told]], wanted[told]
    ranges = (run["digest"] >> U(56)).astype(np.int64) % RANGES
    of_key = key_no[own[told]]
    order = np.lexsort((run["digest"], ranges, of_key))
    run, group = run[order], (of_key * RANGES + ranges)[order]
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else group
    runs = [x.tobytes() for x in np.split(run, cuts[1:])] if len(group) else []
    group = group[cuts]
    n = len(runs)
    none = [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
    yield pa.RecordBatch.from_arrays(
        [pa.array(["border"] * n, pa.string()), *none, pa.array(keys[group // RANGES], pa.int64()),
         pa.array(group % RANGES, pa.int32()), pa.array(runs, pa.binary())], schema=_FOUND,
    )


def _found(kind, a, b, low, high) -> pa.RecordBatch:
    n = len(a)
    return pa.RecordBatch.from_arrays(
        [pa.array([kind] * n, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(low, pa.int64()),
         pa.array(high, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
        schema=_FOUND,
    )


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut a sorted partition into shards of bounded size and solve each."""
    rolling = Rolling(3, SHARD + (1 << 22))
    held, symbols, most = [], 0, SHARD // 256
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            piece = batch.slice(at, most)
            held.append(piece)
            symbols += piece.num_rows * 256
            if symbols >= SHARD:
                yield from _shard(pa.Table.from_batches(held), rolling)
                held, symbols = [], 0
    if held:
        yield from _shard(pa.Table.from_batches(held), rolling)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Border starts that another shard has too: the shards' sorted runs, merged by binary search."""
    keys, runs = [], []
    for batch in batches:
        for key, run in zip(batch.column("key").to_pylist(), batch.column("run").to_pylist()):
            runs.append(np.frombuffer(run, BORDER))
            keys.append(np.full(len(runs[-1]), key))
    if not runs:
        return
    run = np.concatenate(runs)
    both = np.concatenate(keys).astype(U) * U(0x9E3779B97F4A7C15) ^ run["digest"]
    ordered = np.sort(both)
    many = np.searchsorted(ordered, both, "right") - np.searchsorted(ordered, both, "left")
    hit = run[(many > 1) & (run["wanted"] == 1)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(hit[c].copy()) for c in ("a", "b", "low", "low")], ["_a", "_b", "low", "high"]
    )


def _lists(column: pa.ListArray, *names: str) -> tuple[np.ndarray, ...]:
    """Offsets of a list column's rows in its values, and the named fields of the values."""
    values = column.values
    fields = (values.field(n).to_numpy(zero_copy_only=False) for n in names)
    return column.offsets.to_numpy(), *fields


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts that a suffix array must compare, cut from the texts."""
    for batch in batches:
        offsets, place, shape, asks, compared, key = _lists(
            batch.column("hits"), "place", "shape", "asks", "compared", "key"
        )
        at = np.flatnonzero(compared[: offsets[-1]])
        at = at[at >= offsets[0]]
        row = np.searchsorted(offsets, at, "right") - 1
        place, low = place[at], place[at] - shape[at] // WINDOW
        end = low + shape[at] % WINDOW + LENGTH
        texts = batch.column("bytes")
        left, right, last, text = [], [], -1, b""
        for r, x, y, z in zip(row.tolist(), low.tolist(), place.tolist(), end.tolist()):
            if r != last:
                last, text = r, texts[r].as_py()
            left.append(text[x:y])
            right.append(text[y + COMMON : z])
        yield pa.RecordBatch.from_arrays(
            [pa.array(key[at].astype("i8")), batch.column("_a").take(pa.array(row)), batch.column("_b").take(pa.array(row)),
             pa.array(low), pa.array(asks[at]), pa.array(left, pa.binary()), pa.array(right, pa.binary())],
            ["key", "_a", "_b", "low", "asks", "left", "right"],
        )


RESULT = "_a bigint, _b int, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def removed_spans(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal covered runs (start, end) of the strings that start from ``low`` to ``high``."""
    order = np.argsort(low, kind="stable")
    low, end = low[order], np.maximum.accumulate(high[order] + LENGTH)
    new = np.flatnonzero(np.r_[True, low[1:] > end[:-1]])
    return low[new], end[np.r_[new[1:] - 1, len(low) - 1]]


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, place, shape, settled = _lists(batch.column("hits"), "place", "shape", "settled")
        first = place - shape // WINDOW
        final = first + shape % WINDOW
        run_offsets, run_low, run_high = _lists(batch.column("runs"), "low", "high")
        rows = []
        for i, (a, b, text) in enumerate(zip(*(batch.column(c) for c in ("_a", "_b", "bytes")))):
            own, runs = slice(offsets[i], offsets[i + 1]), slice(run_offsets[i], run_offsets[i + 1])
            kept = settled[own]
            low = np.r_[first[own][kept], run_low[runs]].astype(np.int64)
            high = np.r_[final[own][kept], run_high[runs]].astype(np.int64)
            if len(low):
                start, end = removed_spans(low, high)
                digest, at, text = hashlib.sha256(), 0, text.as_py()
                for x, y in zip(start.tolist(), end.tolist()):
                    digest.update(text[at:x])
                    at = y
                digest.update(text[at:])
                spans = [{"start": x, "end": y} for x, y in zip(start.tolist(), end.tolist())]
                rows.append((a.as_py(), b.as_py(), int((end - start).sum()), len(start), digest.hexdigest(), spans))
        columns = list(zip(*rows)) or [()] * 6
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), _SPANS]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["_a", "_b", "n_removed", "n_spans", "kept_sha256", "spans"]
        )


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with a key of 96 bits from id and text; rows equal in both share it, and their result."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id", text.cast("binary").alias("bytes"),
        F.xxhash64("doc_id", text).alias("_a"), F.hash(text).alias("_b"),
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """RESULT for every (id, text) of which something repeats.

    1. Starts of strings are grouped by anchor. Only keys met twice can repeat. Runs of a few bytes
       over and over are told whole, so they don't give an anchor for each byte.
    2. Where a whole context is met twice, all its starts repeat: settled, without its text.
    3. The other contexts of such keys, and one of each kind that is settled beside them, are
       sorted by key over the cluster and cut into shards, each with its suffix array.
    4. Keys that cross a shard's border are merged by digest of the strings.
    Counts come before joins, so a passage in any share of the documents is combined early;
    a key with many contexts is spread over as many shards as it fills.
    """
    keyed = _keyed(docs)
    scanned = materialise(
        keyed.where(F.octet_length("bytes") >= LENGTH).select("_a", "_b", "bytes").mapInArrow(_anchor_rows, ANCHORS),
        "anchors",
    )
    straight = materialise(
        scanned.where(F.col("shape") == RUN).select("_a", "_b", F.col("place").alias("low"), F.col("key").alias("high")), "runs"
    )
    found = scanned.where(F.col("shape") != RUN)
    twice = found.groupBy("key").agg(F.count("*").alias("_n")).where("_n > 1").select("key")
    # A second join column makes Spark shuffle the counts afresh, so that it can split a hot key.
    odd = F.col("key").bitwiseAND(1).alias("_odd")
    met = materialise(
        found.select("*", odd).join(twice.select("key", odd).hint("shuffle_merge"), ["key", "_odd"]).drop("_odd"),
        "anchors-met",
    )
    discard(scanned)
    kinds = materialise(
        met.groupBy("key", "context").agg(
            F.count("*").alias("_n"), F.min(F.struct("_a", "_b", "place")).alias("_one")
        ),
        "anchor-kinds",
    )
    mixed = kinds.groupBy("key").agg(F.min("_n").alias("_least"), F.count("*").alias("_kinds"))
    told = lookup_join(kinds, mixed, ["key"]).withColumn("_open", F.expr("_kinds > 1 AND _least = 1"))
    hits = lookup_join(met, told.select("key", "context", "_n", "_one", "_open"), ["key", "context"]).select(
        "_a", "_b", "key", "place", "shape", (F.col("_n") > 1).alias("settled"),
        (F.col("_open") & (F.col("_n") == 1)).alias("asks"),
        (F.col("_open") & (F.struct("_a", "_b", "place") == F.col("_one"))).alias("compared"),
    )
    hit = F.struct("place", "shape", "settled", "asks", "compared", F.when(F.col("compared"), F.col("key")).otherwise(0).alias("key"))
    by_doc = (
        hits.where("settled OR compared").unionByName(straight.select("_a", "_b"), allowMissingColumns=True)
        .groupBy("_a", "_b").agg(F.collect_list(F.when(F.col("place").isNotNull(), hit)).alias("hits"))
    )
    # The texts of these documents alone go on; the join never switches its form with size.
    touched = materialise(
        keyed.select("_a", "_b", "bytes").join(by_doc.hint("shuffle_merge"), ["_a", "_b"]).dropDuplicates(["_a", "_b"]),
        "repeating-texts",
    )
    discard(met)
    discard(kinds)
    contexts = touched.where(F.exists("hits", lambda h: h["compared"])).mapInArrow(
        _contexts, "key bigint, _a bigint, _b int, low bigint, asks boolean, left binary, right binary"
    )
    spread = F.xxhash64("left", "right")
    compared = touched.agg(F.sum(F.size(F.filter("hits", lambda h: h["compared"])))).first()[0] or 0
    shards = max(1, -(-compared * SYMBOLS // SHARD))
    solved = materialise(
        contexts.withColumn("_spread", spread).repartitionByRange(shards, "key", "_spread").sortWithinPartitions("key", "_spread")
        .drop("_spread").mapInArrow(_shards, FOUND),
        "shards",
    )
    merged = (
        solved.where("kind = 'border'").select("key", "digests", "run")
        .repartition("key", "digests").mapInArrow(_merged, "_a bigint, _b int, low bigint, high bigint")
    )
    runs = (
        solved.where("kind = 'run'").select("_a", "_b", "low", "high").unionByName(merged).unionByName(straight)
        .groupBy("_a", "_b").agg(F.collect_list(F.struct("low", "high")).alias("runs"))
    )
    return touched.join(runs.hint("shuffle_merge"), ["_a", "_b"], "left").mapInArrow(_results, RESULT)


def remove_repeated(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges removed), repeats
    (whether any byte goes).

    Every byte goes that a string of LENGTH bytes covers which also starts anywhere else, in the
    same text or another. Null texts are empty; shorter texts lose nothing; rows that repeat
    lose all of a text that is long enough. Null ids are allowed; an empty table gives no
    rows. Only doc_id and text are read.
    """
    slim = _keyed(docs).select(
        "doc_id", "_a", "_b", F.octet_length("bytes").cast("long").alias("n_bytes"), F.sha2("bytes", 256).alias("_whole")
    )
    found = materialise(repeated_spans(docs), "repeated")
    return slim.join(found, ["_a", "_b"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("kept_sha256", "_whole").alias("kept_sha256"),
        F.coalesce("spans", F.expr("cast(array() AS array<struct<start: bigint, end: bigint>>)")).alias("spans"),
        F.coalesce(F.col("n_removed") > 0, F.lit(False)).alias("repeats"),
    )
