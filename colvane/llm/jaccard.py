"""N-gram Jaccard join by grouped prefixes.

Shingles have one global order, rare ones first (by a sketch of how many documents have them). Sets of similarity t
share a shingle within their first n - ceil(t * n) + 1. Documents with equal sets are one class; classes with the same
prefix and size are one group. Group pairs come from shared prefix shingles, are filtered by size, position and parity
bitmaps, and are expanded to their members, which are verified on their whole texts.

A set's parity bitmap has one bit flipped for each of its shingles, so two bitmaps differ in at most as many bits as the
sets differ in shingles: too many differing bits rule a pair out for certain. Large sets are cut into classes of about
CLASS shingles by their hashes. If two sets are similar, so are their shares of some class (one has at least the mean
overlap), so each class has a prefix of its own, with its own sizes, positions and bitmap. Sets of neighbouring sizes may
have different numbers of classes; the larger one then has both numbers.

Components need no pair inside what is already connected. So before the pairs are made, documents that share a prefix
shingle are tried against one of them (a star, linear in their number; its centre is the document in which the shingle
comes earliest, the least edited of a family of copies), then those still outside the shingle's main component once more. Links that hold are joined up. After that only documents outside the main component of a shingle
are paired, with all of that shingle's documents.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colvane.llm.common import forget, mixed, rebatched, small_batches, stored, texts, trimmed
from colvane.llm.graph import components
from colvane.llm.words import shingle_sets

#: The frequency sketch has ROWS rows of CELLS counters; as sent out it takes a byte each, whatever the corpus.
ROWS, CELLS, PARTS = 2, 1 << 23, 64
#: Words of 64 bits of a class's bitmap, which joins compare; the long ones of whole sets have 1 to 2 bits a shingle.
SHORT = 4
#: Shingles of a class, at most (in the mean).
CLASS = 192
SHORTS = [f"b{i}" for i in range(SHORT)]


def cells(g: np.ndarray) -> list[np.ndarray]:
    """The counter of each shingle in each row."""
    return [((mixed(g, 9 + r) >> np.uint64(64 - 23)) + np.uint64(r * CELLS)).astype(np.int64) for r in range(ROWS)]


def frequency_levels(docs: DataFrame, k: int) -> np.ndarray:
    """Eighths of log2 of the number of documents that have a shingle of each cell. They only order shingles, so collisions cost no result."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(ROWS * CELLS, np.uint32)
        for t in rebatched(batches, size=2_000_000):
            for c in cells(shingle_sets(texts(t), k)[0]):
                np.add.at(seen, c, np.uint32(1))
        for i, part in enumerate(np.split(seen, PARTS)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["part", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                total[i] = total.get(i, 0) + np.frombuffer(zlib.decompress(raw), "<u4").astype(np.uint64)
        for i, x in total.items():
            level = np.minimum(np.round(8 * np.log2(x.astype(np.float64) + 1)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["part", "level"])

    made = docs.select("text").mapInArrow(count, "part int, seen binary").repartitionById(PARTS, F.col("part")).mapInArrow(add, "part int, level binary").toArrow()
    out = np.zeros((PARTS, ROWS * CELLS // PARTS), np.uint8)
    for i, raw in zip(made.column(0).to_pylist(), made.column(1).to_pylist(), strict=True):
        out[i] = np.frombuffer(raw, np.uint8)
    return out.ravel()


def parity(g: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap of a set of hashes: bit h mod `bits` counts, mod 2, the shingles it stands for."""
    odd = np.bincount((g & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little")


def differing(x: bytes, y: bytes) -> int:
    """Bits in which two bitmaps differ; the longer one is folded to the length of the other."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    n = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(v.reshape(-1, n), axis=0) for v in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def divisions(n: int, percent: int) -> list[int]:
    """Numbers of classes of a set of n: as its own size says, and as the smallest similar set's does."""
    return sorted({1 << max(0, -(-x // CLASS) - 1).bit_length() for x in (n, -(-percent * n // 100))})


def prefixes(ordered: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, list[dict]]:
    """(tokens, places, classes) of a set whose shingles are in order: the tokens of each class's prefix, each one's
    place (its position, its class's size and the class, in one word), and number, size and bitmap of the classes."""
    tokens, places, classes = [], [], []
    for m in divisions(len(ordered), percent):
        own = (mixed(ordered, 11) & np.uint64(m - 1)).astype(np.int64)
        order = np.argsort(own, kind="stable")
        g, own = ordered[order], own[order]
        size = np.bincount(own, minlength=m)
        first = np.cumsum(size) - size
        at = np.arange(len(g)) - first[own]
        kept = at <= size[own] - -(-percent * size[own] // 100)
        number = m + own  # of the class, among all divisions
        tokens.append(mixed(g[kept], m))
        places.append((at | size[own] << 24 | number << 44)[kept])
        for c in np.flatnonzero(size).tolist():
            classes.append((m + c, *parity(g[first[c] : first[c] + size[c]] >> np.uint64(32), 64 * SHORT).view(np.int64).tolist()))
    return np.concatenate(tokens), np.concatenate(places), classes


def signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, n, whole, same, bits, tokens, places, maps): set size, hash of the set, hash of its prefixes, long bitmap,
    and prefixes as above."""
    levels = docs.sparkSession.sparkContext.broadcast(frequency_levels(docs, k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        kind = pa.list_(pa.struct([("class", pa.int32()), *((b, pa.int64()) for b in SHORTS)]))
        for t in rebatched(batches, size=3_000_000):
            g, offsets = shingle_sets(texts(t), k)
            own = np.repeat(np.arange(t.num_rows), np.diff(offsets))
            ordered = g[np.lexsort((g, np.minimum.reduce([level[c] for c in cells(g)]), own))]
            n, whole, same, bits, tokens, places, maps = np.diff(offsets).tolist(), [], [], [], [], [], []
            for a, size in zip(offsets[:-1].tolist(), n, strict=True):
                mine = g[a : a + size]
                p, at, classes = prefixes(ordered[a : a + size], percent) if size else (mine, mine.view(np.int64), [])
                whole.append(hashlib.blake2b(mine.tobytes(), digest_size=16).digest())
                same.append(int.from_bytes(hashlib.blake2b(p.tobytes(), digest_size=8).digest(), "little", signed=True))
                bits.append(parity(mine, max(64, 1 << size.bit_length())).tobytes())
                tokens.append(p.view(np.int64))
                places.append(at)
                maps.append([dict(zip(["class", *SHORTS], c, strict=True)) for c in classes])
            ends = pa.array(np.cumsum([0, *map(len, tokens)]), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else [], pa.int64())) for x in (tokens, places)]
            cols = [t.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(same, pa.int64()), pa.array(bits, pa.binary()), *lists, pa.array(maps, kind)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n", "whole", "same", "bits", "tokens", "places", "maps"])

    words = ", ".join(f"{b}: long" for b in SHORTS)
    fields = f"doc_id long, n long, whole binary, same long, bits binary, tokens array<long>, places array<long>, maps array<struct<class: int, {words}>>"
    return stored(docs.select("doc_id", "text").mapInArrow(run, fields), "signatures")


def sieve(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b) of pairs (a, b, n, m, x, y) whose long bitmaps x and y allow the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in trimmed(batches):
            n, m, x, y = (t.column(c).to_pylist() for c in ("n", "m", "x", "y"))
            keep = [differing(v, w) <= i + j - 2 * -(-percent * (i + j) // (100 + percent)) for i, j, v, w in zip(n, m, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([t.column("a"), t.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long")


def similar(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of pairs (a, b, x, y) whose texts x and y have shingle sets with 100 * common >= percent * all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for t in rebatched(batches, "x"):
            rows = list(zip(t.column("x").to_pylist(), t.column("y").to_pylist(), strict=True))
            new = [v for v in dict.fromkeys(v for row in rows for v in row) if v not in held]
            g, offsets = shingle_sets(new, k)
            sets = held | {v: g[a:b] for v, a, b in zip(new, offsets[:-1], offsets[1:], strict=True)}
            keep = []
            for x, y in rows:
                x, y = sets[x], sets[y]
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(bool(len(both)) and 100 * common >= percent * (len(both) - common))
            held = {rows[-1][1]: sets[rows[-1][1]].copy()} if rows else {}  # a star's centre comes again
            yield pa.RecordBatch.from_arrays([t.column("a").combine_chunks(), t.column("b").combine_chunks()], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest id with the same set).

    Null and empty texts have no shingles and stand alone. Null doc_ids take no part: they return with a null component.
    Repeated rows return each; different texts of one doc_id are one document with all their links. An empty table
    gives no rows; other columns are not read. All matches are exact up to 64-bit shingle hashes; nothing is capped.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    signed = signatures(docs, k, percent)
    known = signed.where("doc_id is not null and n > 0")
    # prefixes are shuffled once, by group; all else about documents and classes is narrow
    heads = known.groupBy("n", "same").agg(F.min(F.struct("doc_id", "tokens", "places", "maps")).alias("m"), (F.min("whole") != F.max("whole")).alias("many"))
    groups = stored(heads.select("n", F.col("m.doc_id").alias("gid"), "m.tokens", "m.places", "m.maps", "many"), "groups")
    firsts = known.groupBy("n", "same").agg(F.min("doc_id").alias("gid"))
    each = known.groupBy("n", "whole", "same").agg(F.min(F.struct("doc_id", "bits")).alias("m"))
    classes = stored(each.join(firsts, ["n", "same"]).select("n", "whole", F.col("m.doc_id").alias("id"), "gid", "m.bits"), "classes")
    sizes = stored(signed.select("doc_id", "n", "whole"), "sizes")
    forget(signed)

    # postings of shingles that some pair can share in reach: of two sets the smaller has it early
    unpacked = {"p": "place & 0xFFFFFF", "m": "shiftright(place, 24) & 0xFFFFF", "class": "cast(shiftright(place, 44) as int)"}
    unpacked = {c: F.expr(x.replace("0xFFFFFF", str((1 << 24) - 1)).replace("0xFFFFF", str((1 << 20) - 1))).alias(c) for c, x in unpacked.items()}
    postings = groups.select("gid", F.explode(F.arrays_zip("tokens", "places")).alias("x")).select("gid", F.col("x.tokens").alias("token"), F.col("x.places").alias("place"))
    early = unpacked["p"] <= unpacked["m"] - F.ceil(2 * percent * unpacked["m"] / (100.0 + percent) - 1e-9)
    shared = postings.groupBy("token").agg(F.count("*").alias("c"), F.max(early).alias("some")).where("c > 1 and some").select("token")
    met = stored(postings.join(shared, "token"), "met")
    # cells of sizes: those of similar sets are equal or next to each other
    about = groups.join(met.select("gid").distinct(), "gid").select("gid", "n", "many", F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent)).cast("int").alias("s"), F.explode("maps").alias("x"))
    postings = met.select("gid", "token", *unpacked.values()).join(about.select("gid", "n", "many", "s", "x.*"), ["gid", "class"]).drop("class")
    postings = stored(postings, "postings")
    forget(met, groups)

    loose = classes.where("id <> gid")
    some = postings.select("gid").union(loose.select("id")).union(loose.select("gid")).distinct().withColumnRenamed("gid", "doc_id")
    body = docs.join(some, "doc_id").groupBy(F.col("doc_id").alias("id"), F.xxhash64("text").alias("h")).agg(F.min("text").alias("text")).select("id", "text")
    body = stored(body, "bodies")

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b), stored."""
        one, two = (classes.select(F.col("id").alias(i), F.col("n").alias(n), F.col("bits").alias(x)) for i, n, x in (("a", "n", "x"), ("b", "m", "y")))
        left = sieve(pairs.join(one, "a").join(two, "b"), percent)
        x, y = body.select(F.col("id").alias("a"), F.col("text").alias("x")), body.select(F.col("id").alias("b"), F.col("text").alias("y"))
        return stored(similar(left.join(x, "a").join(y, "b"), k, percent).distinct(), "links")

    need = f"ceil({percent} * (m + m2) / {100 + percent}.0 - 1e-9)"
    differ = " + ".join(f"bit_count({b} ^ {b}2)" for b in SHORTS)
    sized = f"100 * least(n, n2) >= {percent} * greatest(n, n2)"
    alike = f"{differ} <= m + m2 - 2 * {need}"
    fits = f"gid <> gid2 and {sized} and least(m - p, m2 - p2) >= {need}"
    columns = ["gid", "n", "p", "m", *SHORTS]
    second = lambda names: [F.col(c).alias(f"{c}2") for c in names]
    ends = [F.least("gid", "gid2").alias("a"), F.greatest("gid", "gid2").alias("b")]

    def star(rows: DataFrame) -> DataFrame:
        """Pairs of each row with the centre of its token and cell."""
        first = F.min(F.struct((F.col("p") / F.col("m")).alias("share"), F.xxhash64("gid").alias("h"), *columns)).alias("x")
        centres = rows.groupBy("token", "s").agg(first).select("token", "s", *(F.col(f"x.{c}").alias(f"{c}2") for c in columns))
        return rows.join(centres, ["token", "s"]).where(f"{fits} and {alike}").select(ends).distinct()

    def labelled(df: DataFrame) -> DataFrame:
        """Adds the least and the greatest component of each group's members."""
        own = classes.select("gid", "id").join(label, "id").groupBy("gid")
        own = own.agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("c"))
        all_of = classes.groupBy("gid").agg(F.count("*").alias("classes"))
        # a member without a link is a component of its own
        whole = F.col("c") == F.col("classes")
        own = own.join(all_of, "gid").select("gid", F.when(whole, F.col("low")).otherwise(F.least("low", "gid")).alias("low"), F.when(whole, F.col("high")).otherwise(F.lit((1 << 63) - 1)).alias("high"))
        single = F.when(F.col("many"), F.lit((1 << 63) - 1)).otherwise(F.col("gid"))
        return df.join(own, "gid", "left").withColumn("low", F.coalesce("low", "gid")).withColumn("high", F.coalesce("high", single))

    # members of a group against its first one, and a star of each token and cell
    inside = verified(loose.select(F.col("id").alias("a"), F.col("gid").alias("b")))
    done = [inside, verified(star(postings))]
    label = components(done[0].union(done[1]))
    # a token's main component is that of most of its groups; what isn't in it is tried once more
    at = stored(labelled(postings), "at")
    each = at.where("low = high").groupBy("token", "low").agg(F.count("*").alias("c"))
    mains = each.groupBy("token").agg(F.max(F.struct("c", F.col("low").alias("main"))).alias("x")).select("token", "x.main")
    outside = stored(at.join(mains, "token", "left").where("not (low = high and low <=> main)").drop("low", "high"), "outside")
    done.append(verified(star(outside)))
    forget(label)
    label = components(done[0].union(done[1]).union(done[2]))

    # what is outside still, with all groups of its token
    now = labelled(outside).join(label.select(F.col("id").alias("main"), F.col("component").alias("home")), "main", "left")
    now = now.where("not (low = high and low <=> coalesce(home, main))").select("token", "many", *columns)
    near = now.join(at.select("token", *second([*columns, "many"])), "token").where(f"{fits} and (many or many2 or {alike})").select(ends).distinct()
    both = near.select(F.col("a").alias("g"), F.col("b").alias("h"))
    split = labelled(loose.select("gid").distinct().withColumn("many", F.lit(True))).where("low <> high").select(F.col("gid").alias("g"), F.col("gid").alias("h"))
    own = classes.select("id", "gid").join(label, "id", "left").select("id", "gid", F.coalesce("component", "id").alias("c"))
    mine, yours = own.withColumnRenamed("gid", "g"), own.select(F.col("gid").alias("h"), *second(["id", "c"]))
    pairs = both.union(split).join(mine, "g").join(yours, "h").where("id <> id2 and c <> c2")
    done.append(verified(pairs.select(F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b")).distinct()))
    if not done[-1].isEmpty():
        forget(label)
        label = components(done[0].union(done[1]).union(done[2]).union(done[3]))
    forget(*done, at, outside, postings, body)
    named = classes.select("n", "whole", "id").join(label, "id", "left").select("n", "whole", F.col("id").alias("class_id"), F.coalesce("component", "id").alias("component"))
    out = sizes.join(named, ["n", "whole"], "left")
    alone = F.col("doc_id").isNull() | F.col("component").isNull()
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))
