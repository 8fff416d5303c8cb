"""I-Match document fingerprints.

Terms whose share of documents lies in a band make the lexicon. A fingerprint has one 64-bit hash for each of several
randomised subsets of the lexicon: the hash of the sequence of the document's distinct terms in that subset, sorted in
the lexicon's order. Subsets of falling density let both short and long documents keep hashes after edits.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colvane.llm.common import dealt_in_order, mixed, partitions, rebatched, small_batches, texts
from colvane.llm.tokens import CACHE

#: The band: terms in at least this share and at most that share of documents, inverse document frequencies 9.7 to 3.0.
#: A term of the band takes LEAST of the documents, so their number is at most the mean distinct terms of a document / LEAST:
#: with 250 of them 4 million terms, 32 MB broadcast as hashes and 48 MB more in a worker for their subsets.
LEAST, MOST = 2.0**-14, 0.05
#: Subsets: SETS for each density 1, 1/2, 1/4 and so on; each has a hash of 16 hexadecimal digits, zeros if it has no term.
DENSITIES, SETS = 12, 8
SLOTS = DENSITIES * SETS
#: Likeness looks at so many of the sparsest subsets that either document has terms in.
COMPARED = 32
TERM = re.compile(r"\w+")
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def term_hash(w: str) -> int:
    return xxhash.xxh64_intdigest(w)


def membership(h: np.ndarray) -> np.ndarray:
    """Which subsets each term belongs to, (terms, SLOTS): subset j takes a term with probability 2^-(j // SETS)."""
    out = np.zeros((len(h), SLOTS), bool)
    for j in range(SLOTS):
        out[:, j] = mixed(h, 1000 + j) < np.uint64((1 << 64 >> (j // SETS)) - 1)
    return out


def subset_hashes(h: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """The hash of each subset's terms, one after another in the order of h; 0 without terms."""
    slot, term = np.nonzero(inside.T)
    ends, raw, out = np.searchsorted(slot, np.arange(SLOTS + 1)).tolist(), memoryview(h[term].tobytes()), np.zeros(SLOTS, np.uint64)
    for j, (a, b) in enumerate(zip(ends, ends[1:], strict=False)):
        if b > a:
            out[j] = xxhash.xxh64_intdigest(raw[8 * a : 8 * b]) or 1
    return out


@dataclass
class Lexicon:
    """Sorted 64-bit hashes of the band's terms; workers add each term's subsets as bits."""

    hashes: np.ndarray

    def __post_init__(self) -> None:
        self.seen: dict[str, int] = {}
        self.bits: np.ndarray | None = None

    def __getstate__(self):
        return {"hashes": self.hashes, "seen": {}, "bits": None}

    def places(self, terms: set[str]) -> np.ndarray:
        """Places in the lexicon, sorted, of the terms that are in the band."""
        seen = self.seen
        new = [w for w in terms if w not in seen]
        if new:
            if len(seen) > CACHE:
                seen.clear()
                new = list(terms)
            h = np.fromiter(map(term_hash, new), np.uint64, len(new))
            at = np.minimum(np.searchsorted(self.hashes, h), max(len(self.hashes) - 1, 0))
            ok = self.hashes[at] == h if len(self.hashes) else np.zeros(len(h), bool)
            seen.update(zip(new, np.where(ok, at, -1).tolist(), strict=True))
        at = np.array([x for w in terms if (x := seen[w]) >= 0], np.int64)
        at.sort()
        return at

    def fingerprint(self, text: str) -> np.ndarray:
        """A hash for each subset. With no term in the band all the text's terms count; with no terms, the text itself."""
        terms = set(TERM.findall(text.lower()))
        if not terms:
            return np.full(SLOTS, xxhash.xxh64_intdigest(text) or 1, np.uint64)
        if self.bits is None:
            self.bits = np.concatenate([np.packbits(membership(x), axis=1) for x in np.array_split(self.hashes, len(self.hashes) // 50_000 + 1)])
        at = self.places(terms)
        if len(at):
            return subset_hashes(self.hashes[at], np.unpackbits(self.bits[at], axis=1, count=SLOTS).view(bool))
        h = np.sort(np.fromiter(map(term_hash, terms), np.uint64, len(terms)))
        return subset_hashes(h, membership(h))


def as_text(f: np.ndarray) -> str:
    return f.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal hashes among the sparsest COMPARED subsets in which either document has terms."""
    some = np.flatnonzero((a > 0) | (b > 0))[-COMPARED:]
    return float((a[some] == b[some]).mean()) if len(some) else 1.0


def lexicon(docs: DataFrame, least: float = LEAST, most: float = MOST) -> Lexicon:
    """Counts in how many documents each term is, over all documents, and keeps the band (at least one document).

    Counts are summed in Python, then before the shuffle, then after it; only the band's hashes reach the driver,
    and their number has a bound that doesn't grow with the corpus (see LEAST).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            h = np.fromiter(map(term_hash, count), np.uint64, len(count))
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.fromiter(count.values(), np.int64, len(count)))], names=["term", "n"])

        for t in rebatched(batches):
            for x in texts(t):
                for w in set(TERM.findall(x.lower())):
                    count[w] = count.get(w, 0) + 1
            if len(count) > CACHE:
                yield out()
                count.clear()
        if count:
            yield out()

    n = docs.count()
    found = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = found.where(F.col("n").between(max(1, int(np.ceil(least * n))), max(1, int(most * n)))).select("term").toArrow()
    return Lexicon(np.sort(got.column(0).to_numpy().view(np.uint64)))


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many first ones of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text; the next document is the one of next smaller doc_id, after the last the first.

    Documents are dealt into ordered buckets with one shuffle; the first document of each bucket is dealt to the bucket
    before as well, so neighbours meet without one task seeing all. Null texts are empty. Null doc_ids come last, in
    buckets of their own; rows of one doc_id, or of none, are ordered by the hash of their text, then by the text. A
    lone document follows itself; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    sent = spark.sparkContext.broadcast(lexicon(docs))
    dealt, used, nameless = dealt_in_order(docs, "doc_id", partitions(spark), "up")
    h = F.xxhash64("text").alias("h")
    # descending order of ids; then the buckets of null ids, by ranges of the hash
    share = F.floor((F.col("h") / 2.0**64 + 0.5) * nameless)
    place = F.when(F.col("doc_id").isNull(), used + F.least(share, F.lit(max(nameless - 1, 0)))).otherwise(used - 1 - F.least("up", F.lit(used - 1))).cast("int")
    dealt = dealt.select("doc_id", "text", "up", h).select("doc_id", "text", "h", place.alias("bucket"))
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.bitwise_not("doc_id"), "h")
    heads = sorted((r["bucket"], r["m"]["id"], r["m"]["h"]) for r in dealt.groupBy("bucket").agg(F.min_by(F.struct(F.col("doc_id").alias("id"), "h"), key).alias("m")).collect())  # one row a bucket
    # a bucket's head goes to the bucket before, the first one's to the last
    ahead = spark.createDataFrame([(b, i, x, heads[k - 1][0]) for k, (b, i, x) in enumerate(heads)], "bucket int, head long, head_h long, to int")
    mine = F.col("head").eqNullSafe(F.col("doc_id")) & (F.col("head_h") == F.col("h"))
    copies = dealt.join(F.broadcast(ahead), "bucket").select("doc_id", "text", "h", F.explode(F.when(mine, F.array("bucket", -1 - F.col("to"))).otherwise(F.array("bucket"))).alias("b"))
    copies = copies.select("doc_id", "text", "h", (F.col("b") < 0).alias("ahead"), F.when(F.col("b") < 0, -1 - F.col("b")).otherwise(F.col("b")).alias("bucket"))
    ordered = copies.repartitionById(used + nameless, F.col("bucket")).sortWithinPartitions("ahead", F.col("doc_id").desc_nulls_last(), "h", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = sent.value
        last: tuple | None = None
        for t in rebatched(batches, size=2_000_000):
            rows = []
            for doc_id, text, ahead in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist(), t.column("ahead").to_pylist(), strict=True):
                if last and last[3]:
                    break
                own = lex.fingerprint(text)
                if last:
                    new = edited(last[1], text)
                    changed = lex.fingerprint(new)
                    rows.append((last[0], len(last[1]), hashlib.sha256(new.encode()).hexdigest(), as_text(last[2]), as_text(changed), likeness(last[2], changed), likeness(last[2], own)))
                last = doc_id, text, own, ahead
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return ordered.select("doc_id", "text", "ahead").mapInArrow(run, SCHEMA)
