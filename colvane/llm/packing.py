"""Packing by minimum bin slack.

Full windows of a long document stand alone; what remains of each document goes into a pool. A window takes the
pool's longest piece and then the multiset of lengths that comes closest to the capacity, found by subset sums over a
bitset (one Python integer) with counts split in binary, and read back from the stored bitsets.
"""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from colvane.llm.common import rebatched, small_batches, texts
from colvane.llm.tokens import library_encoder, with_end

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def closest_multiset(counts: dict[int, int], lengths: list[int], capacity: int) -> dict[int, int]:
    """How many pieces of each length sum to most without passing capacity; `lengths` are the keys in ascending order."""
    bits, steps, mask = 1, [], (1 << (capacity + 1)) - 1
    for size in reversed(lengths):
        left, k = min(counts[size], capacity // size), 1
        while left > 0:
            take = min(k, left)
            steps.append((size, take, bits))
            bits |= (bits << (size * take)) & mask
            left, k = left - take, k * 2
        if bits >> capacity & 1:
            break
    at, used = bits.bit_length() - 1, {}
    for size, take, before in reversed(steps):
        if not before >> at & 1:
            used[size] = used.get(size, 0) + take
            at -= size * take
    return used


class Packer:
    """Packs a stream of documents; holds at most `pool` pieces, each shorter than a window."""

    def __init__(self, capacity: int, first_sequence: int, pool: int):
        self.capacity, self.sequence, self.limit = capacity, first_sequence, pool
        self.pieces: dict[int, list[tuple]] = {}
        self.lengths: list[int] = []
        self.held = self.tokens = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at, cap = len(ids), 0, self.capacity
        while n - at >= cap:
            self.put(doc_id, at, ids[at : at + cap].tobytes(), n, 0)
            self.sequence += 1
            at += cap
        if at < n:
            self.hold(doc_id, at, ids[at:].tobytes(), n)
            if self.held >= self.limit:
                while self.held > self.limit // 2:
                    self.window()

    def put(self, doc_id, start: int, raw: bytes, total: int, offset: int) -> None:
        self.rows.append((doc_id, start, len(raw) // 4, zlib.crc32(raw), total, self.sequence, offset))

    def hold(self, doc_id, start: int, raw: bytes, total: int) -> None:
        size = len(raw) // 4
        if size not in self.pieces:
            self.pieces[size] = []
            insort(self.lengths, size)
        self.pieces[size].append((doc_id, start, raw, total))
        self.held += 1
        self.tokens += size

    def take(self, size: int) -> tuple:
        got = self.pieces[size].pop()
        if not self.pieces[size]:
            del self.pieces[size]
            self.lengths.remove(size)
        self.held -= 1
        self.tokens -= size
        return got

    def fill(self, chosen: list[tuple]) -> None:
        at = 0
        for doc_id, start, raw, total in chosen:
            self.put(doc_id, start, raw, total, at)
            at += len(raw) // 4
        self.sequence += 1

    def window(self) -> None:
        chosen = [self.take(self.lengths[-1])]
        room = self.capacity - len(chosen[0][2]) // 4
        fitting = [x for x in self.lengths if x <= room]
        if room and fitting:
            for size, k in closest_multiset({x: len(self.pieces[x]) for x in fitting}, fitting, room).items():
                chosen += [self.take(size) for _ in range(k)]
                room -= size * k
        if room and self.held:  # no multiset fits exactly; each piece left is longer than the slack, so one is cut
            chosen.append(self.cut(room))
        self.fill(chosen)

    def cut(self, size: int) -> tuple:
        """The first `size` ids of the shortest piece that has so many; the rest stays in the pool."""
        doc_id, start, raw, total = self.take(next(x for x in self.lengths if x >= size))
        if len(raw) > 4 * size:
            self.hold(doc_id, start + size, raw[4 * size :], total)
        return doc_id, start, raw[: 4 * size], total

    def finish(self) -> None:
        """The last, short windows: lengths that are powers of two, which need no padding."""
        while self.tokens >= self.capacity:
            self.window()
        while self.tokens:
            room, chosen = 1 << (self.tokens.bit_length() - 1), []
            while room:
                small = [x for x in self.lengths if x <= room]
                chosen.append(self.take(small[-1]) if small else self.cut(room))
                room -= len(chosen[-1][2]) // 4
            self.fill(chosen)

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 2, pool: int = 2048) -> DataFrame:
    """Pieces of all documents in sequences of at most `capacity` ids.

    A null or empty text is the end id alone; a null doc_id stays null; repeated rows are packed each; an empty table
    gives no rows; other columns are not read. Each partition packs its own documents in one pass with no shuffle, so
    a hot source changes nothing and a lost task is simply run again with the same result. Only the last window of a
    partition can be short; it is cut into sequences whose lengths are powers of two, which need no padding.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer_path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 32, pool)
        for t in rebatched(batches, size=2_000_000):
            flat, offsets = with_end(*encoder.encode(texts(t)), end_id)
            for doc_id, a, b in zip(t.column("doc_id").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                packer.add(doc_id, flat[a:b])
            yield packer.flush()
        packer.finish()
        yield packer.flush()

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
