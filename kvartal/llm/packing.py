"""Token packing by minimum bin slack."""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

CAPACITY = 2048
END = 1
# Remainders gathered before they are packed; those that fill no window exactly wait for the
# next ones, up to four times as many.
WAITING = 8192
# Texts longer than this are tokenised piece by piece.
PIECE = 1 << 20

SCHEMA = (
    "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, "
    "sequence_id bigint, offset bigint"
)


class Encoder:
    """Ids of the public byte-level BPE, from its rank file: same ids as its tokenizer file, sooner."""

    def __init__(self, name: str):
        import public_tokenizers
        import tiktoken

        with open(public_tokenizers.path(name), encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        with open(public_tokenizers.path(name.replace(".json", ".tiktoken")), "rb") as f:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, f)}
        self.name, self.added = name, tuple(added)
        self.encoding = tiktoken.Encoding(
            "public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added
        )
        self.slow = None

    def _ids(self, text: str) -> list[int]:
        try:
            if any(t in text for t in self.added):
                return self.encoding.encode(text, allowed_special="all")
            return self.encoding.encode_ordinary(text)
        except BaseException as failed:  # the regex engine gives up on some very long runs
            if isinstance(failed, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
            if self.slow is None:
                import public_tokenizers
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(public_tokenizers.path(self.name))
            return self.slow.encode(text, add_special_tokens=False).ids

    def __call__(self, text: str) -> np.ndarray:
        """Ids of the text, then the end id. No token spans a line break that follows a non-space."""
        if len(text) <= PIECE:
            return np.array([*self._ids(text), END], "<u4")
        cuts, at = [0], PIECE
        while at < len(text) and (found := re.compile(r"(?<=\S)\n").search(text, at)):
            cuts.append(found.start())
            at = found.start() + PIECE
        pieces = [np.array(self._ids(text[a:b]), "<u4") for a, b in zip(cuts, [*cuts[1:], len(text)])]
        return np.concatenate([*pieces, np.array([END], "<u4")])


def best_fill(counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """(length, how many) of the multiset that fills ``room`` closest, from the lengths at hand.

    Subset sums are the bits of one integer. Copies of a length are added in powers of two,
    longest lengths first, until the room can be filled; the sums before each step lead back.
    """
    full = (1 << (room + 1)) - 1
    sums, steps = 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, many = min(counts[length], room // length), 1
        while left > 0:
            many = min(many, left)
            steps.append((sums, length, many))
            sums |= (sums << (length * many)) & full
            left, many = left - many, many * 2
        if sums >> room & 1:
            break
    at, taken = sums.bit_length() - 1, defaultdict(int)
    for before, length, many in reversed(steps):
        if not before >> at & 1:
            taken[length] += many
            at -= length * many
    return list(taken.items())


class Packer:
    """Sequences of one partition. ``piece``: (doc_id, start, length, crc, doc_tokens) or longer to cut."""

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity, self.out = first, capacity, []
        self.waiting: dict[int, list] = defaultdict(list)
        self.held = 0

    def emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            self.out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), doc_tokens, self.next, offset))
            offset += len(ids)
        self.next += 1

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, whole = len(ids), len(ids) - len(ids) % self.capacity
        for start in range(0, whole, self.capacity):
            self.emit([(doc_id, start, ids[start : start + self.capacity], n)])
        if whole < n:
            self.waiting[n - whole].append((doc_id, whole, ids[whole:].copy(), n))
            self.held += 1

    def _take(self, fill: list[tuple[int, int]]) -> list[tuple]:
        taken = []
        for length, many in fill:
            own = self.waiting[length]
            taken += [own.pop() for _ in range(many)]
            if not own:
                del self.waiting[length]
        self.held -= len(taken)
        return taken

    def pack(self, last: bool) -> None:
        """Fill windows around the longest remainder. Those not filled wait, or are filled by a cut if ``last``."""
        put_back = []
        while self.waiting:
            longest = max(self.waiting)
            taken = self._take([(longest, 1)])
            room = self.capacity - longest
            fill = best_fill({k: len(v) for k, v in self.waiting.items()}, room)
            slack = room - sum(a * b for a, b in fill)
            if not slack:
                times = min([1 + len(self.waiting.get(longest, ())), *(len(self.waiting[a]) // b for a, b in fill if a != longest)])
                times = max(1, times if all(a != longest for a, _ in fill) else 1)
                self.emit(taken + self._take(fill))
                for _ in range(times - 1):
                    self.emit(self._take([(longest, 1), *fill]))
            elif not last:
                put_back += taken
            else:
                taken += self._take(fill)
                if self.waiting:
                    doc_id, start, ids, n = self._take([(min(self.waiting), 1)])[0]
                    taken.append((doc_id, start, ids[:slack], n))
                    self.waiting[len(ids) - slack].append((doc_id, start + slack, ids[slack:], n))
                    self.held += 1
                self.emit(taken)
        for piece in put_back:
            self.waiting[len(piece[2])].append(piece)
        self.held += len(put_back)

    def ready(self) -> pa.RecordBatch:
        columns = list(zip(*self.out)) or [()] * 7
        self.out = []
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """Pieces of all documents in sequences of at most ``capacity`` tokens; see ``SCHEMA``.

    Each partition packs its own documents in one pass: windows of a document's own tokens
    first, then what remains of it together with other remainders. Only the last sequence of a
    partition may need padding. Nothing is shuffled or grouped, so no key can be hot, and memory
    is bounded by the remainders that wait. Sequence ids carry the partition's number.

    A null text is empty and has the end id alone; null ids stay null; rows that repeat are packed
    each; an empty table gives no rows. Only doc_id and text are read.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = Encoder(tokenizer), Packer(TaskContext.get().partitionId() << 33, capacity)
        full = WAITING
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                packer.add(doc_id, encode(text.as_py() or ""))
                if packer.held >= full:
                    packer.pack(last=packer.held >= 4 * WAITING)
                    full = packer.held + WAITING
            yield packer.ready()
        packer.pack(last=True)
        yield packer.ready()

    return docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "text").mapInArrow(packed, SCHEMA)
