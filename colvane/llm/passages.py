"""Repeated passages by collinear chaining.

Seeds are k-word hashes chosen by winnowing, so equal runs of k + window - 1 words share one. Every seed's occurrences
are joined to its first one (smallest doc_id, then place): a star, linear in the occurrences, so a passage that many
documents share makes no pairs among them. For each document and source the matches are merged along their diagonals
and chained in order under linear gap costs with a Fenwick tree of prefix maxima. Chains are aligned on the words of
both texts, with common subsequences in the gaps, and extended through unequal words at both ends; of an alignment each
longest stretch of the asked identity is a match, down to single anchors. Only verified matches cover others. A chain of
one seed is tried too. An end goes at most 2 * min_words words beyond the outermost seed.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colvane.llm.common import forget, mixed, partitions, rebatched, small_batches, stored, texts, trimmed
from colvane.llm.words import gram_hashes, word_hashes

SEED_WORDS, WINDOW = 6, 8
#: A gap of one word on either side costs so many matched words.
GAP_COST = 0.05
#: Seeds a word along a chain, of 2 / (WINDOW + 1) expected in equal texts, from which it surely verifies.
SURE_SEEDS = 0.15
#: An unequal word costs so many equal ones where an alignment ends.
END_COST = 2
#: Words beyond an unequal one in which an end must make good for it.
STRETCH = 40
#: Cells of a common subsequence up to which all its rows are held.
MOST_CELLS = 1 << 24
SCHEMA = "doc_id long, start long, end long, n_words long, match_doc_id long, match_start long, match_end long, identity double"
#: Chains of a document; those for later lie inside others and are tried where those fail.
FOUND = "doc_id long, found array<struct<source:long,chain:array<long>,later:boolean>>"


def winnowed(h: np.ndarray, doc: np.ndarray, k: int = SEED_WORDS, window: int = WINDOW, long: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """(places, seeds): of each `window` consecutive k-word hashes of a document the smallest; all of shorter documents'
    smallest; and one of each word said `long` times or more on end, so that shorter runs aren't what they meet."""
    g = gram_hashes(h, k)
    if not len(g):
        return np.zeros(0, np.int64), g
    inside = doc[: len(g)] == doc[k - 1 :]
    at = np.flatnonzero(inside)
    g, own = g[at], doc[at]
    chosen = np.zeros(len(g), bool)
    step = 200_000
    for a in range(0, len(g), step):
        part = g[a : a + step + window - 1]
        if len(part) >= window:
            low = np.lib.stride_tricks.sliding_window_view(part, window)
            first = np.arange(len(low))
            whole = own[a : a + len(low)] == own[a + window - 1 : a + window - 1 + len(low)]
            chosen[a + (first + low.argmin(axis=1))[whole]] = True
    n = np.bincount(own)
    starts = np.cumsum(n) - n
    for i in np.flatnonzero((n > 0) & (n < window)):
        chosen[starts[i] + g[starts[i] : starts[i] + n[i]].argmin()] = True
    again = np.zeros(len(g), bool)  # a word said over and over is one seed; alignment walks the rest
    again[1:] = (g[1:] == g[:-1]) & (own[1:] == own[:-1])
    chosen &= ~again
    begin = np.flatnonzero(~again)
    begin = begin[np.diff(begin, append=len(g)) > long - k]
    place, seed = np.concatenate([at[chosen], at[begin]]), np.concatenate([g[chosen], mixed(g[begin], long)])
    order = np.argsort(place, kind="stable")
    return place[order], seed[order]


class Fenwick:
    """Prefix maxima with the index that has them."""

    def __init__(self, n: int):
        self.n, self.best, self.who = n, [float("-inf")] * (n + 1), [-1] * (n + 1)

    def update(self, i: int, value: float, who: int) -> None:
        i += 1
        while i <= self.n:
            if value > self.best[i]:
                self.best[i], self.who[i] = value, who
            i += i & -i

    def query(self, stop: int) -> tuple[float, int]:
        """The largest value at indices below `stop`."""
        best, who = float("-inf"), -1
        while stop > 0:
            if self.best[stop] > best:
                best, who = self.best[stop], self.who[stop]
            stop -= stop & -stop
        return best, who


def anchors(q: np.ndarray, c: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Matches (q, c) merged along diagonals: (q, c, length), where the next begins before the last one's window ends."""
    order = np.lexsort((q, c - q))
    q, c = q[order], c[order]
    new = np.ones(len(q), bool)
    new[1:] = (c[1:] - q[1:] != c[:-1] - q[:-1]) | (q[1:] - q[:-1] > k + WINDOW)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(q)) - 1
    return sorted(zip(q[first].tolist(), c[first].tolist(), (q[last] - q[first] + k).tolist(), strict=True))


def chains(found: list[tuple[int, int, int]], cost: float = GAP_COST) -> list[list[tuple[int, int, int]]]:
    """Disjoint chains of anchors in order in both texts, best first.

    score(i) = length(i) + max(0, score(j) - cost * (gap of j and i in both texts)) over j that end before i begins;
    the gap splits into a part of j and a part of i, so the best j is a prefix maximum over its end in the other text.
    """
    n = len(found)
    if n == 1:
        return [found]
    ends = sorted({c + m for _, c, m in found})
    tree, score, back, waiting, done = Fenwick(len(ends)), [0.0] * n, [-1] * n, sorted(range(n), key=lambda i: found[i][0] + found[i][2]), 0
    for i, (q, c, m) in enumerate(found):
        while done < n and (j := waiting[done]) < i and found[j][0] + found[j][2] <= q:
            qj, cj, mj = found[j]
            tree.update(bisect.bisect_left(ends, cj + mj), score[j] + cost * (qj + mj + cj + mj), j)
            done += 1
        value, j = tree.query(bisect.bisect_right(ends, c))
        gain = value - cost * (q + c)
        score[i], back[i] = (m + gain, j) if j >= 0 and gain > 0 else (float(m), -1)
    used, out = [False] * n, []
    for i in sorted(range(n), key=lambda i: -score[i]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(found[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def common(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """Places (in x, in y) of a longest common subsequence, by integers of len(y) bits; of equal ones the earliest places."""
    if len(x) > 1 and len(x) * len(y) > MOST_CELLS:  # halves of x against the best parts of y need less memory
        half = len(x) // 2
        cut = int((ranks(x[:half], y) + ranks(x[half:][::-1], y[::-1])[::-1]).argmax())
        return common(x[:half], y[:cut]) + [(half + i, cut + j) for i, j in common(x[half:], y[cut:])]
    states, out = list(lengths(x, y)), []
    i, j = len(x), len(y)
    while i and j:
        if states[i] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
            if states[i] >> (j - 1) & 1:
                j -= 1
                out.append((i, j))
    return out[::-1]


def lengths(x: list[int], y: list[int]) -> Iterator[int]:
    """After each prefix of x an integer whose bit j is 0 where y[j] lengthens the subsequence common with y[:j]."""
    where: dict[int, int] = {}
    for i, w in enumerate(y):
        where[w] = where.get(w, 0) | 1 << i
    state = full = (1 << len(y)) - 1
    yield state
    for w in x:
        hit = state & where.get(w, 0)
        state = (state + hit | state - hit) & full
        yield state


def ranks(x: list[int], y: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of x with each prefix of y."""
    *_, state = lengths(x, y)
    bits = np.unpackbits(np.frombuffer(state.to_bytes(len(y) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(y)]
    return np.concatenate([[0], np.cumsum(bits == 0)])


def beyond(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs of places of equal words from the start of both texts on: runs of equal words, and over unequal ones as long
    as what follows within STRETCH words outweighs them at END_COST."""
    out, i, j = [], 0, 0
    while i < len(x) and j < len(y):
        n = min(len(x) - i, len(y) - j)
        size = STRETCH
        while True:  # long equal runs are met in growing steps
            differ = np.flatnonzero(x[i : i + min(n, size)] != y[j : j + min(n, size)])
            if len(differ) or size >= n:
                break
            size *= 4
        run = int(differ[0]) if len(differ) else n
        out.append(np.arange(run)[:, None] + [i, j])
        i, j = i + run, j + run
        pairs = np.array(common(x[i : i + STRETCH].tolist(), y[j : j + STRETCH].tolist()), np.int64).reshape(-1, 2)
        if not len(pairs):
            break
        gap = np.diff(pairs, axis=0, prepend=[[-1, -1]]).max(axis=1) - 1
        worth = np.cumsum(1 - END_COST * gap)
        k = int(worth.argmax())
        if worth[k] <= 0:
            break
        out.append(pairs[: k + 1] + [i, j])
        i, j = i + int(pairs[k, 0]) + 1, j + int(pairs[k, 1]) + 1
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def aligned(chain: list[tuple[int, int, int]], x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both texts of the equal words along a chain, extended at both ends."""
    pieces = []
    for q, c, m in chain:
        m = min(m, len(x) - q, len(y) - c)
        if m > 0:
            pieces.append((q, c, m))
    (q, c, _), (ql, cl, ml) = pieces[0], pieces[-1]
    back, ahead = beyond(x[:q][::-1], y[:c][::-1]), beyond(x[ql + ml :], y[cl + ml :])
    at, to = [q - 1 - back[::-1, 0]], [c - 1 - back[::-1, 1]]
    for k, (q, c, m) in enumerate(pieces):
        if k:
            qp, cp, mp = pieces[k - 1]
            if q > qp + mp and c > cp + mp:
                between = np.array(common(x[qp + mp : q].tolist(), y[cp + mp : c].tolist()), np.int64).reshape(-1, 2)
                at.append(qp + mp + between[:, 0])
                to.append(cp + mp + between[:, 1])
        same = np.flatnonzero(x[q : q + m] == y[c : c + m])
        at.append(q + same)
        to.append(c + same)
    at.append(ql + ml + ahead[:, 0])
    to.append(cl + ml + ahead[:, 1])
    return np.concatenate(at), np.concatenate(to)


def parts(at: np.ndarray, to: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int, int, int, float]]:
    """(q start, q end, c start, c end, identity) of the longest stretches of an alignment that reach min_words and
    identity, then the longest of what is left of it on both sides. Ends with END_COST unequal words or more for two
    equal ones are trimmed, as long as identity and min_words hold."""
    if not len(at):
        return []
    first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(to) != 1)]))
    last = np.append(first[1:], len(at)) - 1
    qs, cs, qe, ce, n = at[first], to[first], at[last] + 1, to[last] + 1, last - first + 1
    total = np.cumsum(n)
    gaps = np.maximum(qs[1:] - qe[:-1], cs[1:] - ce[:-1])
    after = total - END_COST * np.concatenate([[0], np.cumsum(gaps)])  # the score up to each run's end
    share = lambda i, j: float(total[j] - total[i] + n[i]) / max(qe[j] - qs[i], ce[j] - cs[i])
    out, left = [], [(0, len(n))]
    while left:
        lo, hi = left.pop()
        if lo >= hi or qe[hi - 1] - qs[lo] < min_words:
            continue
        best, i, j = 0, -1, -1
        for a in range(lo, hi):
            if qe[hi - 1] - qs[a] < max(min_words, best + 1):
                break
            span = np.maximum(qe[a:hi] - qs[a], ce[a:hi] - cs[a])
            good = np.flatnonzero(total[a:hi] - total[a] + n[a] >= identity * span)
            if len(good) and qe[a + good[-1]] - qs[a] > best:
                i, j = a, a + int(good[-1])
                best = int(qe[j] - qs[i])
        if best < min_words:
            continue
        k = i + int(after[i : j + 1].argmax())
        h = k - int((after[i : k + 1] - n[i : k + 1])[::-1].argmin())
        if share(h, k) >= identity and qe[k] - qs[h] >= min_words:
            i, j = h, k
        out.append((int(qs[i]), int(qe[j]), int(cs[i]), int(ce[j]), share(i, j)))
        left += [(lo, i), (j + 1, hi)]
    return out


def matches(chain: list[tuple[int, int, int]], x: np.ndarray, y: np.ndarray, min_words: int, identity: float) -> list[tuple[int, int, int, int, float]]:
    """The matches along a chain; where they don't cover it, those of its two sides of the widest gap, each extended on its own."""
    out, left = [], [chain]
    while left:
        some = left.pop()
        got = parts(*aligned(some, x, y), min_words, identity)
        out += got
        if len(some) > 1 and not within(some[0][0], some[-1][0] + some[-1][2], sorted((a, b) for a, b, *_ in got)):
            gaps = [max(q - qp - mp, c - cp - mp) for (qp, cp, mp), (q, c, _) in zip(some, some[1:], strict=False)]
            k = 1 + gaps.index(max(gaps))
            left += [some[:k], some[k:]]
    return out


def spans_of(text: str) -> np.ndarray:
    """(start, end) in code points of each word."""
    c = np.frombuffer(text.encode(), np.uint8) if text.isascii() else np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = np.zeros(len(c) + 2, bool)
    inside[1:-1] = (c != 32) & ((c < 9) | (c > 13))
    return np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)


def short_spans(spans: np.ndarray) -> bytes:
    """Spans of words as lengths and gaps, a byte each where they fit (first byte 1), else four."""
    each = np.concatenate([spans[:1, 0], spans[1:, 0] - spans[:-1, 1], spans[:, 1] - spans[:, 0]])
    first, rest = each[:1], each[1:]
    size = 1 if not len(rest) or rest.max() < 256 else 4
    return bytes([size]) + first.astype("<u4").tobytes() + rest.astype(f"<u{size}").tobytes()


def long_spans(raw: bytes) -> np.ndarray:
    rest = np.frombuffer(raw, f"<u{raw[0]}", offset=5).astype(np.int64)
    each = np.concatenate([np.frombuffer(raw, "<u4", 1, 1).astype(np.int64), rest])
    gaps, lengths = np.split(each, 2)
    ends = np.cumsum(gaps + lengths)
    return np.stack([ends - lengths, ends], axis=1)


def fewest(found: list[tuple]) -> list[tuple]:
    """The fewest of these (start, end, ...) that cover all that they cover together. Text that repeats itself matches a
    source at every shift; a few of those matches cover it."""
    found, out, i, at = sorted(found), [], 0, -1
    while i < len(found):
        if found[i][0] > at:  # a gap
            at = found[i][0]
        best = None
        while i < len(found) and found[i][0] <= at:
            if best is None or found[i][1] > best[1]:
                best = found[i]
            i += 1
        if best is not None and best[1] > at:
            out.append(best)
            at = best[1]
    return out


def within(low: int, high: int, cover: list[tuple[int, int]]) -> bool:
    """Whether sorted spans cover low .. high together."""
    for a, b in cover:
        if a <= low < b:
            low = b
    return low >= high


def seeds(docs: DataFrame, min_words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in rebatched(batches, size=2_000_000):
            h, doc = word_hashes(texts(t))
            at, g = winnowed(h, doc, long=min_words)
            n = np.bincount(doc, minlength=t.num_rows)
            own = doc[at]
            ids = np.asarray(t.column("doc_id").combine_chunks(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(ids[own]), pa.array((at - (np.cumsum(n) - n)[own]).astype(np.int32))], names=["seed", "doc_id", "place"])

    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, "seed long, doc_id long, place int")


def chained(seed: DataFrame) -> DataFrame:
    """(doc_id, found: array of (source, flat chain, later)) of documents with chains, from their seeds."""
    spark = seed.sparkSession
    first = seed.groupBy("seed").agg(F.min(F.struct("doc_id", "place")).alias("m"), F.count("*").alias("n")).where("n > 1").select("seed", F.col("m.doc_id").alias("source"), F.col("m.place").alias("there"))
    matches = seed.join(first, "seed").where("source <> doc_id").select("doc_id", "source", "place", "there")
    dealt = matches.repartition(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "source")

    def chains_of(source: int, q: np.ndarray, c: np.ndarray) -> list[tuple]:
        """(span, sure, source, chain) of each chain; sure if seeds match all along it."""
        out, placed = [], np.sort(q)
        for chain in chains(anchors(q, c, SEED_WORDS)):
            low, high = chain[0][0], chain[-1][0] + chain[-1][2]
            seen = int(np.searchsorted(placed, high) - np.searchsorted(placed, low))
            out.append((low, high, seen >= SURE_SEEDS * (high - low), source, chain))
        return out

    def uncovered(found: list[tuple]) -> list[dict]:
        """Marks chains for later that lie inside what longer, sure ones cover: one source is enough for a passage."""
        kept, cover = [], []
        for low, high, ok, source, chain in sorted(found, key=lambda x: (x[0] - x[1], not x[2], x[3])):
            inside = within(low, high, cover)
            kept.append({"source": source, "chain": [v for a in chain for v in a], "later": inside})
            if ok and not inside:
                cover.append((low, high))
                cover.sort()
        return kept

    kind = pa.list_(pa.struct([("source", pa.int64()), ("chain", pa.list_(pa.int64())), ("later", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def out(t: pa.Table) -> pa.RecordBatch:
            d, s, q, c = (t.column(i).to_numpy().astype(np.int64) for i in range(4))
            cuts = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (s[1:] != s[:-1])])).tolist()
            ids, found = [], []
            for a, b in zip(cuts, [*cuts[1:], len(d)], strict=True):
                if got := chains_of(int(s[a]), q[a:b], c[a:b]):
                    if ids and ids[-1] == d[a]:
                        found[-1] += got
                    else:
                        ids.append(int(d[a]))
                        found.append(got)
            found = [uncovered(x) for x in found]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, kind)], names=["doc_id", "found"])

        for b in trimmed(batches):
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            d = t.column(0).to_numpy()
            whole = int(np.searchsorted(d, d[-1]))  # the last document may go on
            if whole and t.num_rows > 20_000:
                yield out(t.slice(0, whole))
                t = t.slice(whole)
            rest = t.combine_chunks()
        if rest is not None:
            yield out(rest)

    return dealt.mapInArrow(run, FOUND)


def repeated_passages(docs: DataFrame, min_words: int = 50, identity: float = 0.8) -> DataFrame:
    """Passages of at least min_words words of a document that an earlier one (smaller doc_id) has, exactly or nearly.

    One source is given for a passage; a match that lies inside longer ones of the same document is left out, and of
    overlapping matches to one source the fewest that cover the same words are listed.
    doc_id, start, end (code points), n_words, match_doc_id, match_start, match_end, identity (matched words over the
    longer side). The first document of a passage is never listed for it. Null doc_ids and null, empty or short texts
    have none; equal rows of one doc_id aren't repeats of each other; a doc_id with different texts names no document and
    takes no part; an empty table gives no rows; other columns are not read. No document, seed or passage is capped.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    unclear = docs.groupBy("doc_id").agg(F.min(h).alias("low"), F.max(h).alias("high")).where("low <> high").select("doc_id")
    if not unclear.isEmpty():
        docs = docs.join(unclear, "doc_id", "left_anti")
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    window = "doc_id long, source long, chains array<array<long>>, low long, words binary, spans binary"

    def clusters(found: list[dict], n: int) -> Iterator[tuple]:
        """(source, chains, low, high): chains to one source whose windows overlap share a window."""
        sides = 2 * min_words  # whatever min_words words around a seed, its ends are in the window
        wanted = sorted((x["source"], max(0, c[0] - sides), min(n, c[-3] + c[-1] + sides), c) for x in found for c in [x["chain"]])
        held: tuple | None = None
        for source, low, high, c in wanted:
            if held and held[0] == source and low <= held[3]:
                held = source, [*held[1], c], held[2], max(held[3], high)
            else:
                if held:
                    yield held
                held = source, [c], low, high
        if held:
            yield held

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in rebatched(batches, size=1_000_000):
            rows = []
            own = texts(t)
            h, doc = word_hashes(own)
            ends = np.searchsorted(doc, np.arange(len(own) + 1))
            for i, (doc_id, found) in enumerate(zip(t.column("doc_id").to_pylist(), t.column("found").to_pylist(), strict=True)):
                w, spans = h[ends[i] : ends[i + 1]], spans_of(own[i])
                for source, some, low, high in clusters(found, len(w)):
                    if high > low:
                        rows.append((doc_id, source, some, low, w[low:high].astype("<u4").tobytes(), short_spans(spans[low:high])))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.list_(pa.int64())), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "source", "chains", "low", "words", "spans"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None, None)
        for t in trimmed(batches):
            rows = []
            for doc_id, source, some, low, words, spans, text in zip(*(c.to_pylist() for c in t.columns), strict=True):
                if held[0] != source:
                    held = source, word_hashes([text or ""])[0].astype("<u4"), None
                x, y = np.frombuffer(words, "<u4"), held[1]
                good = []
                for chain in some:
                    pieces = [(q - low, c, m) for q, c, m in zip(chain[::3], chain[1::3], chain[2::3], strict=True) if 0 <= q - low < len(x) and c < len(y)]
                    if not pieces:
                        continue
                    good += matches(pieces, x, y, min_words, identity)
                if not good:
                    continue
                if held[2] is None:
                    held = *held[:2], spans_of(text or "")
                xs, ys = long_spans(spans), held[2]
                for a, b, c, d, share in fewest(good):
                    rows.append((doc_id, int(xs[a][0]), int(xs[b - 1][1]), b - a, source, int(ys[c][0]), int(ys[d - 1][1]), share, low + a))
            cols = list(zip(*rows, strict=True)) or [()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64() if n == "identity" else pa.int64()) for n, c in zip([*names, "word"], cols, strict=True)], names=[*names, "word"])

    def verified(found: DataFrame) -> DataFrame:
        mine = stored(docs.join(found, "doc_id").select("doc_id", "text", "found").mapInArrow(extract, window), "windows")
        theirs = docs.select(F.col("doc_id").alias("source"), "text").join(mine.select("source").distinct(), "source", "left_semi").groupBy("source").agg(F.max("text").alias("text"))
        both = mine.join(theirs, "source").select("doc_id", "source", "chains", "low", "words", "spans", "text")
        out = stored(both.mapInArrow(align, f"{SCHEMA}, word long"), "verified")
        forget(mine)
        return out

    def failed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Chains that were left for later and lie in nothing that is verified."""
        for t in trimmed(batches):
            ids, rows = [], []
            for doc_id, found, spans in zip(*(c.to_pylist() for c in t.columns), strict=True):
                cover = sorted((x["word"], x["word"] + x["n_words"]) for x in spans or [])
                if some := [x for x in found if not within(x["chain"][0], x["chain"][-3] + x["chain"][-1], cover)]:
                    ids.append(doc_id)
                    rows.append(some)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, t.schema.field("found").type)], names=["doc_id", "found"])

    seed = stored(seeds(docs, min_words), "seeds")
    found = stored(chained(seed), "chains")
    forget(seed)
    done = verified(found.withColumn("found", F.filter("found", lambda x: ~x["later"])))
    later = found.withColumn("found", F.filter("found", lambda x: x["later"])).where("size(found) > 0")
    spans = done.groupBy("doc_id").agg(F.collect_list(F.struct("word", "n_words")).alias("spans"))
    rest = stored(later.join(spans, "doc_id", "left").select("doc_id", "found", "spans").mapInArrow(failed, FOUND), "later")
    if not rest.isEmpty():
        done = done.union(verified(rest))
    return done.select(names)


def without_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the found passages cut from their texts (all but the first document's copy goes); n_chars follows."""
    columns = docs.columns
    name = "_spans" + "_" * max(map(len, columns))  # no column has it
    spans = found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias(name))
    joined = docs.join(spans, "doc_id", "left")
    start = F.struct(F.lit("").alias("kept"), F.lit(0).cast("long").alias("at"))
    step = lambda acc, s: F.struct(F.when(s["start"] > acc["at"], F.concat(acc["kept"], F.substring("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")))).otherwise(acc["kept"]).alias("kept"), F.greatest(acc["at"], s["end"]).alias("at"))
    cut = F.aggregate(name, start, step, lambda acc: F.concat(acc["kept"], F.substring("text", (acc["at"] + 1).cast("int"), F.length("text"))))
    joined = joined.withColumn("text", F.when(F.col(name).isNull(), F.col("text")).otherwise(cut))
    if "n_chars" in columns:
        joined = joined.withColumn("n_chars", F.when(F.col(name).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return joined.select(columns)
