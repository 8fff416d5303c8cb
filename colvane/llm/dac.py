"""Token ids on disk as directly addressable codes.

A shard is one uncompressed file. It splits every id into chunks of fixed widths, lowest bits first. Level 0 has the
first chunk of all ids; a bitmap says which go on, and level 1 has the second chunk of just those, and so on. A rank
directory over each bitmap (ones before every block of 512 bits) gives the place of an id's next chunk, so any id is
read by a few seeks, of at most 80 bytes a level.

Shard layout, little-endian: magic "DAC1", u32 levels, u64 ids, u64 documents, u32 widths[levels], u64 entries[levels],
then u64 starts of documents (documents + 1), i64 doc_ids, and for each level: the chunks, and but for the last level
the bitmap (padded to whole blocks) and its directory (u32).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colvane.llm.common import bucket_of, ordered_bounds, partitions, rebatched, shared_dir, small_batches, stored, texts
from colvane.llm.tokens import library_encoder, with_end

MAGIC, BLOCK = b"DAC1", 512
#: Ids of a shard; a shard is written by one task.
SHARD_IDS = 1_000_000
#: How a missing doc_id is kept.
NONE = -(1 << 63)


def widths_for(ids: np.ndarray, choices: tuple[tuple[int, ...], ...] = ((8, 8, 16), (16, 16), (12, 4, 16), (13, 3, 16), (11, 5, 16))) -> tuple[int, ...]:
    """Of these splits the one that takes least room for these ids (levels nobody reaches take none)."""

    def room(widths: tuple[int, ...]) -> int:
        total, below = 0, 0
        for w in widths:
            total += int(np.count_nonzero(ids >> below)) * (w + 1) if below else len(ids) * (w + 1)
            below += w
        return total

    return min(choices, key=room)


def packed(values: np.ndarray, width: int) -> bytes:
    """Chunks of `width` bits, one after another; chunk i begins at bit i * width."""
    if width == 8:
        return values.astype("u1").tobytes()
    if width == 16:
        return values.astype("<u2").tobytes()
    bits = (values[:, None] >> np.arange(width, dtype=values.dtype) & 1).astype(np.uint8)
    return np.packbits(bits.ravel(), bitorder="little").tobytes() + b"\0" * 8


def unpacked(raw: memoryview, n: int, width: int) -> np.ndarray:
    if width == 8:
        return np.frombuffer(raw, "u1", n).astype(np.uint32)
    if width == 16:
        return np.frombuffer(raw, "<u2", n).astype(np.uint32)
    at = np.arange(n, dtype=np.int64) * width
    b = np.frombuffer(raw, "u1")
    i, shift = at >> 3, (at & 7).astype(np.uint32)
    word = b[i].astype(np.uint32) | b[i + 1].astype(np.uint32) << np.uint32(8) | b[i + 2].astype(np.uint32) << np.uint32(16)
    return word >> shift & np.uint32((1 << width) - 1)


def chunk_bytes(n: int, width: int) -> int:
    return n if width == 8 else 2 * n if width == 16 else -(-n * width // 8) + 8


def shard(doc_ids: list, lengths: list[int], ids: np.ndarray) -> bytes:
    """A shard of documents; a null doc_id is kept as the smallest 64-bit number."""
    ids = ids.astype(np.uint32)
    widths = widths_for(ids)
    parts, entries, rest = [], [], ids
    for i, w in enumerate(widths):
        entries.append(len(rest))
        parts.append(packed(rest & np.uint32((1 << w) - 1), w))
        if i + 1 < len(widths):
            rest = rest >> np.uint32(w)
            more = rest > 0
            blocks = -(-len(more) // BLOCK)
            bitmap = np.zeros(blocks * BLOCK // 8, np.uint8)
            bitmap[: -(-len(more) // 8)] = np.packbits(more, bitorder="little")
            ones = np.bitwise_count(bitmap).reshape(blocks, BLOCK // 8).sum(axis=1, dtype=np.int64)
            parts += [bitmap.tobytes(), (np.cumsum(ones) - ones).astype("<u4").tobytes()]
            rest = rest[more]
    head = [MAGIC, struct.pack("<IQQ", len(widths), len(ids), len(lengths)), np.array(widths, "<u4").tobytes(), np.array(entries, "<u8").tobytes()]
    docs = [np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tobytes(), np.array([NONE if d is None else d for d in doc_ids], "<i8").tobytes()]
    return b"".join(head + docs + parts)


class ShardReader:
    """Reads a shard in place through `read(offset, size)`: any id by `token`, any run by `run`, all by `all`."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        raw = read(0, 24)
        if raw[:4] != MAGIC:
            raise ValueError("not a shard")
        levels, self.n, self.docs = struct.unpack_from("<IQQ", raw, 4)
        raw = read(24, 12 * levels)
        widths, entries = np.frombuffer(raw, "<u4", levels).tolist(), np.frombuffer(raw, "<u8", levels, 4 * levels).tolist()
        self.at = at = 24 + 12 * levels
        at += 8 * (2 * self.docs + 1)
        self.levels = []  # entries, width, places of chunks, bitmap and directory
        for i, (n, w) in enumerate(zip(entries, widths, strict=True)):
            chunks, blocks = at, -(-n // BLOCK)
            at += chunk_bytes(n, w)
            last = i + 1 == levels
            self.levels.append((n, w, chunks, None if last else at, None if last else at + blocks * BLOCK // 8))
            at += 0 if last else blocks * (BLOCK // 8 + 4)

    @classmethod
    def of(cls, raw: bytes) -> ShardReader:
        return cls(lambda at, size: raw[at : at + size])

    @classmethod
    def open(cls, path: str) -> ShardReader:
        """A shard's file in any store that pyarrow reaches by its URI or local path."""
        fs, name = pyarrow.fs.FileSystem.from_uri(path)
        f = fs.open_input_file(name)
        return cls(lambda at, size: f.read_at(size, at))

    @property
    def starts(self) -> np.ndarray:
        return np.frombuffer(self.read(self.at, 8 * (self.docs + 1)), "<u8").astype(np.int64)

    @property
    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self.read(self.at + 8 * (self.docs + 1), 8 * self.docs), "<i8")

    def token(self, i: int) -> int:
        """The i-th id: one chunk, one block of the bitmap and one rank a level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        out = shift = 0
        for _, w, chunks, bitmap, directory in self.levels:
            out |= (int.from_bytes(self.read(chunks + (i * w >> 3), 4), "little") >> (i * w & 7) & ((1 << w) - 1)) << shift
            if bitmap is None:
                return out
            block, bit = divmod(i, BLOCK)
            bits = int.from_bytes(self.read(bitmap + block * BLOCK // 8, BLOCK // 8), "little")
            if not bits >> bit & 1:
                return out
            (rank,) = struct.unpack("<I", self.read(directory + 4 * block, 4))
            i, shift = rank + (bits & ((1 << bit) - 1)).bit_count(), shift + w
        return out

    def run(self, first: int, stop: int) -> np.ndarray:
        return np.array([self.token(i) for i in range(first, stop)], "<u4")

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        out, at, shift = np.zeros(self.n, np.uint32), None, 0
        for n, w, chunks, bitmap, _ in self.levels:
            v = unpacked(memoryview(self.read(chunks, chunk_bytes(n, w))), n, w) << np.uint32(shift)
            if at is None:
                out = v
            else:
                out[at] |= v
            if bitmap is not None:
                more = np.flatnonzero(np.unpackbits(np.frombuffer(self.read(bitmap, -(-n // 8)), np.uint8), count=n, bitorder="little"))
                at = more if at is None else at[more]
                if not len(at):
                    break
            shift += w
        return out.astype("<u4")


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes all documents' ids, in ascending doc_id, to shard files in the shared folder; returns their table.

    One row a shard: bucket and place in it (their order is the order of the ids), the number of ids, and the path. A
    file's name has its own number, and the table lists only the files of tasks that ended well, so a task that is run
    again harms nothing. Ids are made before the shuffle, so two bytes an id move and not the text. Ties of doc_id are in
    the order of their ids' crc32, then bytes; null doc_ids come last, in buckets of their own by the same order; a null
    text has the end id alone; an empty table makes no file; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    bounds, nameless = ordered_bounds(docs, "doc_id", partitions(spark))
    used = len(bounds) + 1
    folder = f"{shared_dir(spark)}/dac-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder.removeprefix('file:')}"

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer_path)
        for t in rebatched(batches):
            flat, offsets = with_end(*encoder.encode(texts(t)), end_id)
            flat = flat.astype("<u2") if flat.max() < 1 << 16 else flat
            size, ends = flat.itemsize, offsets.tolist()
            raw = memoryview(flat.tobytes())
            made = [raw[a * size : b * size] for a, b in zip(ends, ends[1:], strict=False)]
            crc = np.fromiter(map(zlib.crc32, made), np.int64, len(made))
            ids = t.column("doc_id").combine_chunks().cast(pa.int64())
            none = np.asarray(ids.is_null())
            bucket = np.where(none, used + (crc * nameless >> 32), bucket_of(bounds, ids)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([ids, pa.array(bucket), pa.array(crc), pa.array(np.full(len(made), size, np.int32)), pa.array(made, pa.binary())], names=["doc_id", "bucket", "crc", "size", "ids"])

    def shards_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        bucket = TaskContext.get().partitionId()
        place, doc_ids, lengths, parts = 0, [], [], []

        def out() -> pa.RecordBatch:
            ids, name = np.concatenate(parts), f"{bucket:08d}-{place:08d}-{uuid.uuid4().hex}.dac"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(f"{root}/{name}") as f:
                f.write(shard(doc_ids, lengths, ids))
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([place], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([f"{folder}/{name}"])], names=["bucket", "place", "n_ids", "path"])

        have = 0
        for b in batches:
            for doc_id, size, raw in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.frombuffer(raw, f"<u{size}")
                doc_ids.append(doc_id)
                lengths.append(len(ids))
                parts.append(ids)
                have += len(ids)
                if have >= shard_ids:
                    yield out()
                    place, doc_ids, lengths, parts, have = place + 1, [], [], [], 0
        if parts:
            yield out()

    ids = docs.mapInArrow(ids_of, "doc_id long, bucket int, crc long, size int, ids binary")
    ordered = ids.repartitionById(used + nameless, F.col("bucket")).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), "crc", "ids").select("doc_id", "size", "ids")
    return stored(ordered.mapInArrow(shards_of, "bucket long, place long, n_ids long, path string"), "dac")


def firsts(shards: DataFrame) -> DataFrame:
    """(bucket, place, first): ids before each shard. Sums of sizes are made in two steps (groups of buckets, then inside
    a group), so no task sees all shards of a large table."""
    sizes = shards.select("bucket", "place", "n_ids", F.floor(F.col("bucket") / 256).alias("many"))
    totals = sizes.groupBy("many").agg(F.sum("n_ids").alias("n"))
    before = totals.select("many", (F.sum("n").over(Window.orderBy("many")) - F.col("n")).alias("ahead"))
    inner = sizes.select("many", "bucket", "place", (F.sum("n_ids").over(Window.partitionBy("many").orderBy("bucket", "place")) - F.col("n_ids")).alias("inner"))
    return inner.join(before, "many").select("bucket", "place", (F.col("inner") + F.col("ahead")).alias("first"))


def token(shards: DataFrame, i: int) -> int:
    """The i-th id of all: one row of the table, then a few seeks in one file."""
    found = shards.join(firsts(shards), ["bucket", "place"]).where((F.col("first") <= i) & (F.col("first") + F.col("n_ids") > i)).first() if i >= 0 else None
    if found is None:
        raise IndexError(i)
    return ShardReader.open(found["path"]).token(i - found["first"])


def read(shards: DataFrame) -> DataFrame:
    """Documents of a written table, from its files alone: doc_id, start, n_tokens, ids_crc32."""

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, first in zip(*(b.column(i).to_pylist() for i in range(2)), strict=True):
                reader = ShardReader.open(path)
                ids, starts, doc_ids = memoryview(reader.all().tobytes()), reader.starts, reader.doc_ids
                ends = starts.tolist()
                crc = [zlib.crc32(ids[4 * x : 4 * y]) for x, y in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64(), mask=doc_ids == NONE), pa.array(first + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    # the table of shards is small, so its rows are dealt out again: each task opens a few files
    dealt = shards.join(firsts(shards), ["bucket", "place"]).select("path", "first").repartition(partitions(shards.sparkSession), "path")
    return dealt.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
