"""Quality by supervised subword embeddings: hashed word and character n-gram vectors, averaged, softmax, numpy SGD.

The output is linear in the averaged vector, so scoring needs one number a feature: its vector times the difference of
the two output rows. A distinct word's features are summed once a batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colvane.llm.common import held_out, mixed, only, ragged, rebatched, small_batches, texts, trimmed
from colvane.llm.labels import training_rows

BUCKETS = 1 << 18
DIMENSIONS = 16
#: The bound on labelled documents that training reads.
MAX_TRAIN = 4_000
#: Lengths of character n-grams of a word between its marks.
GRAMS = (2, 3, 4)


def bucket(h: np.ndarray) -> np.ndarray:
    return (mixed(h, 11) >> np.uint64(64 - 18)).astype(np.int32)


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, word of each, hash of each word): the word itself and its character n-grams between < and >."""
    code = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)
    spread = mixed(code, 1)
    with np.errstate(over="ignore"):
        h = np.bincount(of, minlength=len(words)).astype(np.uint64)
        np.add.at(h, of, mixed(spread * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), 3))
        feats, owners = [bucket(h)], [np.arange(len(words))]
        for n in GRAMS:
            if len(code) < n:
                continue
            g = np.full(len(code) - n + 1, n, np.uint64)
            for k in range(n):
                g = g * np.uint64(0x100000001B3) ^ spread[k : k + len(g)]
            inside = of[: len(g)] == of[n - 1 :]
            feats.append(bucket(g[inside]))
            owners.append(of[: len(g)][inside])
    return np.concatenate(feats), np.concatenate(owners), h


def split_words(docs: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(word of each place, words a document, distinct words); words are cut at ASCII white space, with case and marks kept."""
    lists = pc.ascii_split_whitespace(pa.array(docs, pa.large_string()))
    coded = pc.dictionary_encode(lists.values)
    codes, distinct = np.asarray(coded.indices, dtype=np.int64), coded.dictionary.to_pylist()
    doc = np.repeat(np.arange(len(docs)), np.diff(np.asarray(lists.offsets, dtype=np.int64)))
    if "" in distinct:
        kept = codes != distinct.index("")
        codes, doc = codes[kept], doc[kept]
    return codes, np.bincount(doc, minlength=len(docs)), distinct


def pair_features(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of neighbouring words, and whether a word repeats the one before it; with the document of each."""
    if len(h) < 2:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    same = np.flatnonzero(doc[1:] == doc[:-1])
    with np.errstate(over="ignore"):
        two = np.where(h[same] == h[same + 1], np.uint64(12345), h[same] * np.uint64(5) + h[same + 1])
    return bucket(two), doc[same]


def document_features(docs: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(distinct features, counts) of each document."""
    codes, n, words = split_words(docs)
    f, owner, h = word_features(words)
    order = np.argsort(owner, kind="stable")
    f, size = f[order].astype(np.int64), np.bincount(owner, minlength=len(words))
    start = np.cumsum(size) - size
    out, at = [], 0
    for k in n.tolist():
        own = codes[at : at + k]
        two, _ = pair_features(h[own], np.zeros(k, np.int64))
        out.append(np.unique(np.concatenate([f[ragged(start[own], size[own])], two.astype(np.int64)]), return_counts=True))
        at += k
    return out


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 8, rate: float = 0.15, size: int = 32, seed: int = 1) -> tuple[np.ndarray, float]:
    """One number a feature and a bias, from (label, features, counts) of documents: SGD with a step for each row."""
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS)).astype(np.float32)
    out, bias = np.zeros((2, DIMENSIONS), np.float32), np.zeros(2, np.float32)
    out[:] = rng.normal(0, 0.3, out.shape)
    power, out_power = np.full(BUCKETS, 1e-10, np.float32), 1e-8
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), size):
            part = [rows[i] for i in order[at : at + size] if len(rows[i][1])]
            if not part:
                continue
            f = np.concatenate([x for _, x, _ in part])
            share = np.concatenate([c / c.sum() for _, _, c in part]).astype(np.float32)
            n = np.array([len(x) for _, x, _ in part])
            doc = np.repeat(np.arange(len(part)), n)
            mean = np.add.reduceat(vec[f] * share[:, None], np.cumsum(n) - n, axis=0)
            z = mean @ out.T + bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), [y for y, *_ in part]] -= 1
            touched, where = np.unique(f, return_inverse=True)
            hidden = (p @ out)[doc] * share[:, None]
            g = np.stack([np.bincount(where, hidden[:, k], minlength=len(touched)) for k in range(DIMENSIONS)], axis=1).astype(np.float32)
            power[touched] += (g * g).mean(axis=1)
            vec[touched] -= rate * g / np.sqrt(power[touched])[:, None]
            go = p.T @ mean
            out_power += float((go * go).mean())
            out -= 0.5 * rate * go / np.sqrt(out_power)
            bias -= 0.02 * p.mean(axis=0)
        rate *= 0.8
    return vec @ (out[1] - out[0]), float(bias[1] - bias[0])


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, limit: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Fits on at most `limit` labelled documents that aren't held out; executors make the feature counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in rebatched(batches, size=1_000_000):
            made = document_features(texts(t))
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks().cast(pa.int64()), t.column("y").combine_chunks(), pa.array([f.astype("<i4").tobytes() for f, _ in made], pa.binary()), pa.array([c.astype("<u4").tobytes() for _, c in made], pa.binary())], names=["doc_id", "y", "f", "c"])

    small_batches(docs.sparkSession)
    got = training_rows(docs, labels, "quality", modulus, remainder, limit).mapInArrow(run, "doc_id long, y int, f binary, c binary").toArrow().sort_by("doc_id")
    rows = [(y, np.frombuffer(f, "<i4"), np.frombuffer(c, "<u4")) for y, f, c in zip(*(got.column(x).to_pylist() for x in "yfc"), strict=True)]
    return fit(rows)


def document_scores(u: np.ndarray, bias: float, docs: list[str]) -> np.ndarray:
    """Softmax probability of label 1; a text with no words has the bias alone."""
    codes, n, words = split_words(docs)
    f, owner, h = word_features(words)
    word_sum, word_n = np.bincount(owner, u[f], minlength=len(words)), np.bincount(owner, minlength=len(words))
    doc = np.repeat(np.arange(len(docs)), n)
    two, two_doc = pair_features(h[codes], doc)
    total = np.bincount(doc, word_sum[codes], minlength=len(docs)) + np.bincount(two_doc, u[two], minlength=len(docs))
    count = np.bincount(doc, word_n[codes], minlength=len(docs)) + np.bincount(two_doc, minlength=len(docs))
    return 1 / (1 + np.exp(-(bias + total / np.maximum(count, 1))))


def score(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id and score of every row, over its whole text.

    Null and empty texts get the bias's score; null doc_ids and repeated rows stay; an empty table gives no rows; other
    columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, bias = sent.value
        for t in rebatched(batches, size=3_000_000):
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(document_scores(u, bias, texts(t)), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def scorer(spark: SparkSession, model: tuple[np.ndarray, float]) -> Callable[[Column], Column]:
    """The score as a column of a text column, so that a row keeps its own; null texts get the bias's score."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only()
        for x in trimmed(parts):
            yield pa.array(document_scores(*sent.value, ["" if t is None else t for t in x.to_pylist()]), pa.float64())

    return score


def quality(docs: DataFrame, labels: DataFrame, modulus: int = 4, remainder: int = 2, threshold: float = 0.7) -> DataFrame:
    """Learns from rows that aren't held out and scores all: doc_id, held_out, score, predicted."""
    s = score(docs, learn(docs, labels, modulus, remainder))
    return s.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
