"""Nearest neighbours by stable projections in kd-trees.

Vectors get one more component, so that the largest inner product becomes the smallest distance, and are projected to
a few dimensions with Gaussian numbers. For a projected distance d' of vectors at distance d, (d' / d)^2 has a
chi-square distribution.

A coarse kd-tree over the projections deals all vectors to cells, each once; a block is a cell, or a part of a cell that
very many equal vectors share. Each block has its own kd-tree. A query first searches blocks of the cells nearest to it.
Its k-th best distance then bounds the blocks it must visit besides: those whose cell the chi-square test can't exclude. Inside a
block it takes leaves in ascending bounds on the projected distance, in growing steps, verifies their vectors exactly, and
stops when the chi-square distribution says that a better vector would by now have been seen with the asked probability.
Queries of a batch that reach a leaf in the same step are verified there by one matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from colvane.llm.common import small_batches, stored

#: Projected dimensions (even), points of a leaf, vectors of a block, and the stopping probability.
PROJECTED, LEAF, BLOCK, SURE = 12, 128, 16_384, 0.98
#: Vectors that the coarse tree is fitted on, and the most cells it has. All vectors are dealt by it.
SAMPLE, MOST_CELLS = 32_768, 4_096
#: Cells that a query searches first.
HOMES = 4


def chi_square(x: np.ndarray, m: int = PROJECTED) -> np.ndarray:
    """Distribution function for an even number of degrees of freedom."""
    half = np.asarray(x, np.float64) / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_quantile(p: float, m: int = PROJECTED) -> float:
    low, high = 0.0, 1e4
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(np.array([mid]), m)[0] < p else (low, mid)
    return high


class KdTree:
    """A balanced tree that halves the widest dimension; leaves keep their boxes."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.leaves: list[np.ndarray] = []
        waiting = [np.arange(len(points))]
        while waiting:
            own = waiting.pop()
            if len(own) <= leaf:
                self.leaves.append(own)
                continue
            p = points[own]
            axis = int((p.max(axis=0) - p.min(axis=0)).argmax())
            order = np.argpartition(p[:, axis], len(own) // 2)
            waiting += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]
        self.low = np.stack([points[x].min(axis=0) for x in self.leaves])
        self.high = np.stack([points[x].max(axis=0) for x in self.leaves])

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The smallest squared distance of each row of q to each leaf's box."""
        out = np.zeros((len(q), len(self.low)))
        for axis in range(q.shape[1]):
            gap = np.maximum(self.low[:, axis] - q[:, axis : axis + 1], 0) + np.maximum(q[:, axis : axis + 1] - self.high[:, axis], 0)
            out += gap * gap
        return out


class Cells:
    """A coarse kd-tree: halves the widest dimension of a sample until there are so many cells, which fill all space."""

    def __init__(self, points: np.ndarray, cells: int):
        m = points.shape[1]
        self.low, self.high = np.full((1, m), -np.inf), np.full((1, m), np.inf)
        self.splits: list[tuple[int, int, float, int]] = []  # cell, axis, value, the new cell of what lies above
        waiting = [(0, np.arange(len(points)))]
        while waiting and len(self.low) < cells:
            waiting.sort(key=lambda x: -len(x[1]))
            cell, own = waiting.pop(0)
            if len(own) < 2:
                break
            p = points[own]
            axis = int((p.max(axis=0) - p.min(axis=0)).argmax())
            value = float(np.median(p[:, axis]))
            above = p[:, axis] > value
            if not above.any() or above.all():  # equal points
                continue
            new = len(self.low)
            self.low, self.high = np.vstack([self.low, self.low[cell]]), np.vstack([self.high, self.high[cell]])
            self.high[cell, axis] = self.low[new, axis] = value
            self.splits.append((cell, axis, value, new))
            waiting += [(cell, own[~above]), (new, own[above])]

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int32)
        for cell, axis, value, new in self.splits:
            out[(out == cell) & (points[:, axis] > value)] = new
        return out

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """The smallest squared distance of q to each cell."""
        gap = np.maximum(self.low - q, 0) + np.maximum(q - self.high, 0)
        return (gap * gap).sum(axis=1)


def basis(d: int) -> np.ndarray:
    return np.random.default_rng(d).normal(size=(d + 1, PROJECTED))


def projected(vectors: np.ndarray, longest: float) -> np.ndarray:
    """Vectors with the component that makes them all `longest` long, projected."""
    b = basis(vectors.shape[1])
    extra = np.sqrt(np.maximum(longest * longest - (vectors * vectors).sum(axis=1), 0))
    return vectors @ b[:-1] + extra[:, None] * b[-1]


def target(q: np.ndarray, longest: float) -> np.ndarray:
    """A query scaled to the longest length, which keeps the order of inner products, projected; distances are then
    2 * longest^2 - 2 * (scaled product)."""
    return q * (longest / math.sqrt(float(q @ q))) @ basis(len(q))[:-1]


class Block:
    """Vectors of a block, leaf by leaf, with the tree over their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, longest: float):
        self.longest = longest
        self.tree = KdTree(projected(vectors, longest))
        order = np.concatenate(self.tree.leaves)
        self.ids, self.vectors = ids[order], vectors[order]
        self.ends = np.concatenate([[0], np.cumsum([len(x) for x in self.tree.leaves])])

    def nearest(self, asks: np.ndarray, q: np.ndarray, k: int, stop: float, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query's row, vector's row, score) of the k best found for each query; `stop` is the chi-square quantile of
        the asked probability, `far` the distance within which k are known already."""
        length = np.sqrt((q * q).sum(axis=1))
        bound = self.tree.bounds(np.stack([target(x, self.longest) for x in q]))
        rank = bound.argsort(axis=1).argsort(axis=1)
        far, least = far.copy(), np.full(len(q), -np.inf)
        best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        low, high = 0, 4
        while low < len(self.tree.leaves):
            reach = (rank >= low) & (bound <= stop * far[:, None])
            if not reach.any():
                break
            reach &= rank < high
            rows, points = [], []
            for leaf in np.flatnonzero(reach.any(axis=0)).tolist():
                own, a = np.flatnonzero(reach[:, leaf]), self.ends[leaf]
                s = q[own] @ self.vectors[a : self.ends[leaf + 1]].T
                i, j = np.nonzero((s >= (least[own] - 1e-9 * np.abs(least[own]))[:, None]) & (self.ids[a : self.ends[leaf + 1]] != asks[own][:, None]))
                rows.append(own[i])
                points.append(a + j)
            r, p = np.concatenate(rows or [best[0]]), np.concatenate(points or [best[0]])
            # products of rows alone, so that equal vectors have equal scores wherever they lie
            s = np.concatenate([(self.vectors[p[i : i + 50_000]] * q[r[i : i + 50_000]]).sum(axis=1) for i in range(0, len(p), 50_000)] or [best[2]])
            r, p, s = (np.concatenate(x) for x in zip(best, (r, p, s), strict=True))
            order = np.lexsort((self.ids[p], -s, r))
            r, p, s = r[order], p[order], s[order]
            place = np.arange(len(r)) - np.searchsorted(r, r)
            best = r[place < k], p[place < k], s[place < k]
            full = best[0][np.flatnonzero(place[place < k] == k - 1)]
            least[full] = best[2][place[place < k] == k - 1]
            far[full] = np.minimum(far[full], np.maximum(0.0, 2 * self.longest**2 - 2 * least[full] * self.longest / length[full]))
            low, high = high, 3 * high
        return best


def usable(vectors: DataFrame) -> DataFrame:
    """Rows with an id and a vector of finite components that isn't zero; those alone take part."""
    v = F.col("embedding")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & v.isNotNull()).where((F.size(v) > 0) & F.coalesce(fine, F.lit(False))).where(F.exists(v, lambda x: x != 0)).select("vec_id", F.transform(v, lambda x: x.cast("double")).alias("v"))


def by_length(t: pa.Table | pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each length in a batch."""
    lists = t.column("v")
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    flat, offsets = lists.values.to_numpy(zero_copy_only=False), np.asarray(lists.offsets)
    size = np.diff(offsets)
    for d in np.unique(size).tolist():
        rows = np.flatnonzero(size == d)
        yield rows, flat[offsets[rows][:, None] + np.arange(d)]


def nearest(vectors: DataFrame, modulus: int = 20, k: int = 20, sure: float = SURE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id divisible by `modulus`) the k largest inner products found.

    Vectors null, zero or with null or non-finite components take no part; vectors of other lengths are met only by
    queries of their own length. Every row of another id is a candidate, so repeated rows return each; a repeated query
    id asks once, with its largest vector. Fewer candidates than k are all returned; ties go to the smaller vec_id. An
    empty table gives no rows; other columns are not read.

    Every vector is shuffled twice, to its one block, and a query to the blocks it visits; a task holds one block and
    takes queries one after another.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    own = stored(usable(vectors), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    sizes = own.agg(F.count("*").alias("n"), F.coalesce(F.max(norm), F.lit(1.0)).alias("longest")).first()
    n, longest, stop = sizes["n"], sizes["longest"] * (1 + 1e-12), chi_square_quantile(sure)

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, m in by_length(b):
                yield pa.RecordBatch.from_arrays([pa.array(list(projected(m, longest)), pa.list_(pa.float64()))], names=["p"])

    some = own.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).mapInArrow(points, "p array<double>").toArrow() if n > BLOCK else None
    cells = Cells(np.array(some.column("p").to_pylist()).reshape(-1, PROJECTED) if some else np.zeros((0, PROJECTED)), min(MOST_CELLS, -(-n // BLOCK)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.zeros(b.num_rows, np.int32)
            for rows, m in by_length(b):
                cell[rows] = cells.of(projected(m, longest))
            yield pa.RecordBatch.from_arrays([pa.array(cell), *b.columns], names=["cell", *b.schema.names])

    dealt = stored(own.mapInArrow(deal, "cell int, vec_id long, v array<double>"), "dealt")
    full = {r["cell"]: -(-r["n"] // BLOCK) for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most MOST_CELLS rows
    parts = np.array([full.get(i, 0) for i in range(len(cells.low))])
    first = np.cumsum(parts) - parts
    blocks = max(int(parts.sum()), 1)
    sent = spark.sparkContext.broadcast((cells, first, parts))
    table = spark.createDataFrame([(i, int(a), int(m)) for i, (a, m) in enumerate(zip(first, parts, strict=True))], "cell int, first int, parts int")
    placed = dealt.join(F.broadcast(table), "cell").select((F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.greatest("parts", F.lit(1))).cast("int")).alias("block"), F.lit(False).alias("query"), "vec_id", "v", F.lit(None).cast("double").alias("far"))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(block, ...) for each block a query visits: first those of the nearest cells; with `far`, the others in reach."""
        cells, first, parts = sent.value
        used = np.flatnonzero(parts)
        for b in batches:
            later, far = "far" in b.schema.names, None
            if later:
                far = b.column("far").to_numpy(zero_copy_only=False)
            row, block = [], []
            for rows, m in by_length(b):
                for i, q in zip(rows.tolist(), m, strict=True):
                    bound = cells.bounds(target(q, longest))
                    home = used[np.argsort(bound[used], kind="stable")[:HOMES]]
                    to = first[home].tolist()
                    if later:
                        near = used if np.isnan(far[i]) else used[bound[used] <= stop * far[i]]
                        at_home = set(to)
                        to = [x for c in near.tolist() for x in range(first[c], first[c] + parts[c]) if x not in at_home]
                    row += [i] * len(to)
                    block += to
            made = b.select(["vec_id", "v"]).take(pa.array(row, pa.int64()))
            limit = b.column("far").take(pa.array(row, pa.int64())) if later else pa.nulls(len(row), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), *made.columns, limit], names=["block", "vec_id", "v", "far"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Vectors of a partition's block come first, then queries."""
        held, made = [], None
        for b in batches:
            asked = np.asarray(b.column("query").to_numpy(zero_copy_only=False), bool)
            if not asked.all():
                held.append(b.filter(pa.array(~asked)))
            if not asked.any():
                continue
            if made is None:
                made = {}
                t = pa.Table.from_batches(held).combine_chunks() if held else None
                for rows, m in by_length(t) if t is not None else ():
                    made[m.shape[1]] = Block(t.column("vec_id").to_numpy()[rows], m, longest)
            b = b.filter(pa.array(asked))
            ids, far, out = b.column("vec_id").to_numpy(), b.column("far").to_numpy(zero_copy_only=False), []
            for rows, m in by_length(b):
                if (block := made.get(m.shape[1])) is not None:
                    asks = ids[rows]
                    r, p, scores = block.nearest(asks, m, k, stop, np.where(np.isnan(far[rows]), np.inf, far[rows]))
                    out.append((asks[r], block.ids[p], scores))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    def searched(asks: DataFrame) -> DataFrame:
        visits = asks.mapInArrow(route, "block int, vec_id long, v array<double>, far double").withColumn("query", F.lit(True))
        both = placed.unionByName(visits).repartitionById(blocks, F.col("block")).sortWithinPartitions("query")
        return both.mapInArrow(search, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    asks = own.where(F.col("vec_id") % modulus == 0).groupBy("vec_id").agg(F.max("v").alias("v"))
    if blocks == 1:
        return best(searched(asks)).select("query_id", "rank", "vec_id", "score")
    home = stored(best(searched(asks)).drop("rank"), "home")
    known = home.groupBy(F.col("query_id").alias("vec_id")).agg(F.count("*").alias("n"), F.min("score").alias("s"))
    far = F.when(F.col("n") >= k, F.greatest(F.lit(0.0), 2 * longest**2 - 2 * longest * F.col("s") / norm))
    rest = searched(asks.join(known, "vec_id", "left").select("vec_id", "v", far.alias("far")))
    return best(home.union(rest)).select("query_id", "rank", "vec_id", "score")
