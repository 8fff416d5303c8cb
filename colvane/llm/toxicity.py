"""Toxicity by multiple-instance learning: sentences are scored, a document's score is their noisy-or.

Labels are of documents only. A sentence has probability p = sigmoid(b + sum of its features' weights), a document
1 - prod(1 - p). The gradient reaches each sentence through the noisy-or, so the sentences that explain a label learn.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colvane.llm.common import held_out, mixed, only, ragged, rebatched, small_batches, stored, texts, trimmed
from colvane.llm.labels import training_rows

#: Hashed features of a word: itself, its first 3 to 6 characters, its last 3 and 4.
FEATURES = 1 << 20
FIRST, LAST = (3, 4, 5, 6), (3, 4)
#: The bound on labelled documents that training reads.
MAX_TRAIN = 8_000
#: A feature is learned if so many training documents have it, and if the log odds of its label are so many standard errors from 0.
MIN_DOCS, MIN_ERRORS = 8, 3.5
TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
ENDS = frozenset(".!?\n")
SCHEMA = "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>"


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, word of each) of distinct words."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    code = mixed(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64), 1)
    start = np.cumsum(size) - size
    of = np.repeat(np.arange(len(words)), size)
    every, feats, owners = np.arange(len(words)), [], []

    def add(h: np.ndarray, own: np.ndarray, kind: int) -> None:
        feats.append((mixed(h, kind) >> np.uint64(64 - 20)).astype(np.int64))
        owners.append(own)

    with np.errstate(over="ignore"):
        whole = size.astype(np.uint64)
        place = np.arange(len(code)) - start[of]
        np.add.at(whole, of, mixed(code * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)), 3))
        add(whole, every, 5)
        for lengths, kind, at in ((FIRST, 20, lambda own, k: start[own] + k), (LAST, 40, lambda own, k: start[own] + size[own] - 1 - k)):
            h, own = np.zeros(len(words), np.uint64), every
            for k in range(max(lengths)):
                long = size[own] > k
                h, own = h[long], own[long]
                h = (h ^ code[at(own, k)]) * np.uint64(0x100000001B3)
                if k + 1 in lengths:
                    add(h, own, kind + k)
    return np.concatenate(feats), np.concatenate(owners)


def sentences(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(word of each place, its sentence, document of each sentence, distinct words); only sentences with words count."""
    cut = [TOKEN.findall(t.lower()) for t in docs]
    doc = np.repeat(np.arange(len(docs)), np.fromiter(map(len, cut), np.int64, len(cut)))
    coded = pc.dictionary_encode(pa.array([w for ws in cut for w in ws], pa.string()))
    codes, words = np.asarray(coded.indices, dtype=np.int64), coded.dictionary.to_pylist()
    ends = np.array([w in ENDS for w in words], bool)[codes] if words else np.zeros(0, bool)
    opens = np.zeros(len(codes), bool)
    opens[1:] = ends[:-1] | (doc[1:] != doc[:-1])
    run = np.cumsum(opens)
    kept, sent = np.unique(run[~ends], return_inverse=True)
    doc_of = np.zeros(len(kept), np.int64)
    doc_of[sent] = doc[~ends]
    return codes[~ends], sent, doc_of, words


def features(docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, sentence of each, document of each sentence)."""
    codes, sent, doc_of, words = sentences(docs)
    f, owner = word_features(words)
    order = np.argsort(owner, kind="stable")
    size = np.bincount(owner, minlength=len(words))
    start = np.cumsum(size) - size
    return f[order][ragged(start[codes], size[codes])], np.repeat(sent, size[codes]), doc_of


def log_not(z: np.ndarray) -> np.ndarray:
    """log(1 - sigmoid(z))"""
    return -np.logaddexp(0, z)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -z))


def document_scores(w: np.ndarray, bias: float, docs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of each document, score of each sentence, document of each sentence). A text with no words counts as one sentence with no features."""
    codes, sent, doc_of, words = sentences(docs)
    f, owner = word_features(words)
    z = bias + np.bincount(sent, np.bincount(owner, w[f], minlength=len(words))[codes], minlength=len(doc_of))
    clear = np.bincount(doc_of, log_not(z), minlength=len(docs))
    clear[np.bincount(doc_of, minlength=len(docs)) == 0] = log_not(np.array([bias]))[0]
    return -np.expm1(clear), sigmoid(z), doc_of


def leaning(seen: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features that lean clearly to one label, and their first weights; n has the number of documents of each label."""
    odds = np.log((seen[1] + 2 * n[1] / n.sum()) / n[1]) - np.log((seen[0] + 2 * n[0] / n.sum()) / n[0])
    error = np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    ids = np.flatnonzero((seen.sum(axis=0) >= MIN_DOCS) & (np.abs(odds) > MIN_ERRORS * error))
    return ids, np.maximum(odds[ids], 0) / 2


def fit(rows: list[tuple], seen: np.ndarray | None = None, epochs: int = 30, rate: float = 0.03, pull: float = 3e-4, positive: float = 2.0, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias from (label, features, sentence of each[, number of sentences]) of documents.

    `seen` has the number of documents of each label (0, 1) with each feature; without it rows are counted.

    Only features that lean clearly to one label take part; they start from half their log odds. Then stochastic
    gradient descent on the noisy-or's log loss, with `positive` times the weight for label 1 and a pull to the start.
    """
    w, bias, rng = np.zeros(FEATURES, np.float64), -4.0, np.random.default_rng(seed)
    n = np.array([sum(1 for y, *_ in rows if y != 1), sum(1 for y, *_ in rows if y == 1)])
    if not n.all():
        return w, bias
    if seen is None:
        seen = np.zeros((2, FEATURES), np.int64)
        for y, f, *_ in rows:
            seen[int(y == 1), np.unique(f)] += 1
    ids, start = leaning(seen, n)
    place = np.full(FEATURES, -1, np.int64)
    place[ids] = np.arange(len(ids))
    data = []
    for y, f, s, *k in rows:
        p = place[f]
        data.append((y, p[p >= 0], s[p >= 0], k[0] if k else int(s.max()) + 1 if len(s) else 1))
    own, size = start.copy(), 64
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for at in range(0, len(order), size):
            part = [data[i] for i in order[at : at + size]]
            first = np.cumsum([0] + [k for *_, k in part])
            f = np.concatenate([p for _, p, _, _ in part])
            s = np.concatenate([q + o for (_, _, q, _), o in zip(part, first, strict=False)])
            doc = np.repeat(np.arange(len(part)), [k for *_, k in part])
            y = np.array([x for x, *_ in part])[doc]
            z = bias + np.bincount(s, own[f], minlength=first[-1])
            clear = np.bincount(doc, log_not(z), minlength=len(part))
            odds_left = np.exp(clear) / np.maximum(-np.expm1(clear), 1e-9)
            push = np.clip(sigmoid(z) * np.where(y == 1, -positive * odds_left[doc], 1.0), -positive, 1)
            own -= rate * (np.bincount(f, push[s], minlength=len(own)) + pull * size * (own - start))
            bias -= 0.1 * rate * push.sum()
    w[ids] = own
    return w, float(bias)


def learn(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, limit: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """Fits the model on at most `limit` labelled documents.

    Executors count features by label; the driver gets counts of features in MIN_DOCS documents, chooses those that
    lean, and then gets the chosen features of each sentence alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = stored(training_rows(docs, labels, "toxic", modulus, remainder, limit), "training")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, FEATURES), np.int32)
        for t in rebatched(batches, size=1_000_000):
            f, sent, doc_of = features(texts(t))
            y = np.asarray(t.column("y").combine_chunks(), np.int64) == 1
            pair = np.unique(doc_of[sent] * FEATURES + f) if len(f) else f
            np.add.at(seen, (y[pair // FEATURES].astype(np.int64), pair % FEATURES), 1)
        for label in (0, 1):
            ids = np.flatnonzero(seen[label])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), label)), pa.array(ids), pa.array(seen[label][ids].astype(np.int64))], names=["y", "f", "n"])

    each = rows.mapInArrow(count, "y long, f long, n long").groupBy("f").agg(*(F.coalesce(F.sum(F.when(F.col("y") == y, F.col("n"))), F.lit(0)).alias(f"n{y}") for y in (0, 1)))
    common = each.where(F.col("n0") + F.col("n1") >= MIN_DOCS).toArrow()
    seen = np.zeros((2, FEATURES), np.int64)
    for y in (0, 1):
        seen[y, common.column("f").to_numpy()] = common.column(f"n{y}").to_numpy()
    totals = rows.agg(F.sum((F.col("y") != 1).cast("long")), F.sum((F.col("y") == 1).cast("long"))).first()
    n = np.array([totals[0] or 0, totals[1] or 0])
    if not n.all():
        return fit([])
    chosen = spark.sparkContext.broadcast(leaning(seen, n)[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.zeros(FEATURES, bool)
        wanted[chosen.value] = True
        for t in rebatched(batches, size=1_000_000):
            f, sent, doc_of = features(texts(t))
            f, sent = f[wanted[f]], sent[wanted[f]]
            doc = doc_of[sent]
            order = np.argsort(doc, kind="stable")
            f, sent, cuts = f[order], sent[order], np.searchsorted(doc[order], np.arange(t.num_rows + 1))
            first = np.searchsorted(doc_of, np.arange(t.num_rows + 1))
            fs = [f[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            ss = [(sent[a:b] - o).astype("<i4").tobytes() for a, b, o in zip(cuts, cuts[1:], first, strict=False)]
            k = np.maximum(np.diff(first), 1)
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks().cast(pa.int64()), t.column("y").combine_chunks(), pa.array(fs, pa.binary()), pa.array(ss, pa.binary()), pa.array(k)], names=["doc_id", "y", "f", "s", "k"])

    got = rows.mapInArrow(run, "doc_id long, y int, f binary, s binary, k long").toArrow().sort_by("doc_id")
    data = [(y, np.frombuffer(f, "<i4").astype(np.int64), np.frombuffer(s, "<i4").astype(np.int64), k) for y, f, s, k in zip(*(got.column(c).to_pylist() for c in "yfsk"), strict=True)]
    return fit(data, seen)


def score(docs: DataFrame, model: tuple[np.ndarray, float], offending: float = 0.5) -> DataFrame:
    """doc_id, score and the sentences (start, end in code points, score) that score `offending` or more.

    Every row is scored over its whole text; null and empty texts score as a sentence with no features; null doc_ids
    and repeated rows stay; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    w, bias = model
    sent_weights = spark.sparkContext.broadcast((w.astype(np.float32), bias))

    def spans(text: str, p: list[float]) -> list[dict]:
        out, start, k = [], None, 0
        for m in [*TOKEN.finditer(text.lower() if len(text.lower()) == len(text) else text), None]:
            if m and m[0] not in ENDS:
                start, end = m.start() if start is None else start, m.end()
            elif start is not None:
                if k < len(p) and p[k] >= offending:
                    out.append({"start": start, "end": end, "score": p[k]})
                start, k = None, k + 1
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = sent_weights.value
        for t in rebatched(batches, size=2_000_000):
            own = texts(t)
            s, p, doc_of = document_scores(w, bias, own)
            cuts = np.searchsorted(doc_of, np.arange(len(own) + 1))
            hit = np.zeros(len(own), bool)
            hit[doc_of[p >= offending]] = True
            found = [spans(x, p[cuts[i] : cuts[i + 1]].tolist()) if hit[i] else [] for i, x in enumerate(own)]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks().cast(pa.int64()), pa.array(s, pa.float64()), pa.array(found, kind)], names=["doc_id", "score", "offending"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def scorer(spark: SparkSession, model: tuple[np.ndarray, float]) -> Callable[[Column], Column]:
    """The score as a column of a text column, so that a row keeps its own; null texts score as empty ones."""
    small_batches(spark)
    sent = spark.sparkContext.broadcast((model[0].astype(np.float32), model[1]))

    @F.arrow_udf("double")
    def score(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        only()
        for x in trimmed(parts):
            yield pa.array(document_scores(*sent.value, ["" if t is None else t for t in x.to_pylist()])[0], pa.float64())

    return score


def toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1, threshold: float = 0.7) -> DataFrame:
    """Learns from rows that aren't held out and scores all: doc_id, held_out, score, predicted, offending."""
    s = score(docs, learn(docs, labels, modulus, remainder))
    return s.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "offending")
