"""Distributed vectors: a DataFrame of positions i (dense, from 0) and values v.

Operators that move positions do it by arithmetic on i, so most need no shuffle. Positions come from a total order in
two steps that no single task carries: rows are range-partitioned and stored, partitions are counted, and each row's
place inside its partition is added to the count of all before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colvane.session import stored

#: Rows of a block in two-step folds.
BLOCK = 65_536


def dense_index(df: DataFrame, *keys: str | Column, name: str = "i") -> DataFrame:
    """Adds positions 0, 1, ... in the order of keys."""
    keys = tuple(F.col(k) if isinstance(k, str) else k for k in keys)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    kept = stored(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id() % (1 << 33)), "ordered")
    counts = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count("*").alias("n")).collect())  # one row a partition
    firsts, total = [], 0
    for part, n in counts:
        firsts.append((part, total))
        total += n
    first = F.broadcast(df.sparkSession.createDataFrame(firsts, "_part int, _first long"))
    return kept.join(first, "_part").withColumn(name, F.col("_first") + F.col("_place")).drop("_part", "_place", "_first")


def overlapping(df: DataFrame, k: int, i: str = "_i") -> DataFrame:
    """Rows by block of positions (_b), the last k - 1 of a block in the next one too; _home is a row's own block."""
    b = F.floor(F.col(i) / BLOCK)
    late = F.when((F.col(i) % BLOCK) >= BLOCK - k + 1, F.array(b, b + 1)).otherwise(F.array(b))
    return df.select("*", b.alias("_home"), F.explode(late).alias("_b"))


def running(df: DataFrame, by: str, order: str, value: str, fold: Callable = F.max, both: Callable = F.greatest, name: str = "run") -> DataFrame:
    """Adds a running fold of each key, in two steps: totals of blocks of a key, then a fold inside each block."""
    at = dense_index(df, by, order, name="_i").withColumn("_b", F.floor(F.col("_i") / BLOCK))
    ahead = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = at.groupBy(by, "_b").agg(fold(value).alias("_t")).select(F.col(by).alias("_by"), F.col("_b").alias("_tb"), fold("_t").over(ahead).alias("_ahead"))
    inside = fold(value).over(Window.partitionBy(by, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0))
    whole = at.withColumn("_w", inside).join(totals, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_b") == F.col("_tb")))
    return whole.withColumn(name, both(F.col("_ahead"), F.col("_w"))).drop("_i", "_b", "_by", "_tb", "_ahead", "_w")


class Vector:
    """Positions and values; `n` is the length, counted once when needed."""

    def __init__(self, df: DataFrame, n: int | None = None):
        self.df, self._n = df.select("i", "v"), n

    @classmethod
    def of(cls, df: DataFrame, value: str, *keys: str) -> Vector:
        return cls(dense_index(df.select(*dict.fromkeys([*keys, value])), *keys).select("i", F.col(value).alias("v")))

    @classmethod
    def enumerate(cls, spark, n: int) -> Vector:
        return cls(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("v")), n)

    @property
    def n(self) -> int:
        if self._n is None:
            self._n = self.df.count()
        return self._n

    def _moved(self, i: Column, keep: Column | None = None, n: int | None = None) -> Vector:
        df = self.df if keep is None else self.df.where(keep)
        return Vector(df.select(i.cast("long").alias("i"), "v"), n)

    def map(self, f: Callable[[Column], Column]) -> Vector:
        return Vector(self.df.select("i", f(F.col("v")).alias("v")), self._n)

    def map_index(self, f: Callable[[Column, Column], Column]) -> Vector:
        return Vector(self.df.select("i", f(F.col("i"), F.col("v")).alias("v")), self._n)

    def zip(self, other: Vector, f: Callable[[Column, Column], Column]) -> Vector:
        """Pairwise; the shorter length counts."""
        o = other.df.select("i", F.col("v").alias("w"))
        return Vector(self.df.join(o, "i").select("i", f(F.col("v"), F.col("w")).alias("v")))

    def each_left(self, a: Column | Vector, f) -> Vector | DataFrame:
        """f(a, v) for each value; with a vector a, (i, r) with the list of f(a, v) over a for each value."""
        return self.map(lambda v: f(a, v)) if isinstance(a, Column) else self._each_of(a, f)

    def each_right(self, a: Column | Vector, f) -> Vector | DataFrame:
        """f(v, a) for each value; with a vector a, (i, r) with the list of f(v, a) over a for each value."""
        return self.map(lambda v: f(v, a)) if isinstance(a, Column) else self._each_of(a, lambda x, v: f(v, x))

    def _each_of(self, a: Vector, f, most: int = 1_000_000) -> DataFrame:
        """The other side is one row of a list, which must fit; its length is checked."""
        if a.n > most:
            raise ValueError(f"the other side has more than {most} values")
        side = a.df.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("_a"))
        return self.df.crossJoin(F.broadcast(side)).select("i", F.transform("_a", lambda x: f(x, F.col("v"))).alias("r"))

    def each_pair(self, f) -> Vector:
        """f of neighbours, one value fewer: a join of positions, so no task holds all."""
        after = self.df.select((F.col("i") - 1).alias("i"), F.col("v").alias("w"))
        return Vector(self.df.join(after, "i").select("i", f(F.col("v"), F.col("w")).alias("v")))

    def reverse(self) -> Vector:
        return self._moved(F.lit(self.n - 1) - F.col("i"), n=self.n)

    def rotate(self, k: int) -> Vector:
        """+k moves to the right, -k to the left."""
        return self._moved(F.pmod(F.col("i") + k, F.lit(max(self.n, 1))), n=self.n)

    def take(self, k: int) -> Vector:
        """First k or last -k values; more than there are go round."""
        n = self.n
        if abs(k) > n and n:
            start = 0 if k >= 0 else (n - -k % n) % n
            copies = F.sequence(F.pmod(F.col("i") - start, F.lit(n)), F.lit(abs(k) - 1), F.lit(n))
            fits = F.pmod(F.col("i") - start, F.lit(n)) < abs(k)
            return Vector(self.df.where(fits).select(F.explode(copies).alias("i"), "v").withColumn("i", F.col("i").cast("long")), abs(k))
        return self._moved(F.col("i"), F.col("i") < k, min(k, n)) if k >= 0 else self._moved(F.col("i") - (n + k), F.col("i") >= n + k, -k)

    def drop(self, k: int) -> Vector:
        n = self.n
        return self._moved(F.col("i") - k, F.col("i") >= k, max(n - k, 0)) if k >= 0 else self._moved(F.col("i"), F.col("i") < n + k, max(n + k, 0))

    def at(self, index: Vector) -> Vector:
        """Values at the positions that `index` holds, in its order; those out of range are undefined."""
        return Vector(index.df.select(F.col("i").alias("o"), F.col("v").alias("i")).join(self.df, "i", "left").select(F.col("o").alias("i"), "v"), index._n)

    def amend(self, value, positions: list[int]) -> Vector:
        """`value` at the given positions, a literal list."""
        return self.map_index(lambda i, v: F.when(i.isin(positions), F.lit(value)).otherwise(v))

    def amend_from(self, changes: Vector) -> Vector:
        """Values of `changes` at their own positions, for any number of them."""
        new = changes.df.select("i", F.col("v").alias("w"), F.lit(True).alias("hit"))
        return Vector(self.df.join(new, "i", "left").select("i", F.when(F.col("hit"), F.col("w")).otherwise(F.col("v")).alias("v")), self._n)

    def where(self) -> DataFrame:
        """Positions of true values."""
        return self.df.where("v <> 0").select("i")

    def expand(self) -> DataFrame:
        """Each position as often as its value says."""
        return self.df.where("v > 0").select("i", F.explode(F.sequence(F.lit(1), F.col("v").cast("int"))).alias("copy")).select("i", "copy")

    def find(self, value) -> DataFrame:
        return self.df.where(F.col("v") == F.lit(value)).select("i")

    def first(self) -> DataFrame:
        return self.df.agg(F.min_by("v", "i").alias("v"))

    def concat(self, other: Vector) -> Vector:
        return Vector(self.df.union(other.df.select(F.col("i") + self.n, "v")), self.n + other.n)

    def cut(self, places: list[int]) -> DataFrame:
        """(seg, i, v): the segment grows at each place; equal places leave empty segments."""
        seg = sum((F.when(F.col("i") >= p, 1).otherwise(0) for p in places), F.lit(0))
        return self.df.select(seg.cast("long").alias("seg"), "i", "v")

    def split(self, size: int | list[int]) -> DataFrame:
        """(seg, j, v): segments of a fixed size, or of sizes that go round."""
        if not isinstance(size, int):
            if not size or min(size) < 1:
                raise ValueError("sizes must be positive")
            total, starts = sum(size), [sum(size[:k]) for k in range(len(size))]
            place = F.col("i") % total
            part = sum((F.when(place >= x, 1).otherwise(0) for x in starts[1:]), F.lit(0))
            first = F.element_at(F.array(*map(F.lit, starts)), part + 1)
            return self.df.select((F.floor(F.col("i") / total) * len(size) + part).alias("seg"), (place - first).alias("j"), "v")
        return self.df.select(F.floor(F.col("i") / size).alias("seg"), (F.col("i") % size).alias("j"), "v")

    def split_balanced(self, size: int) -> DataFrame:
        """(seg, j, v): as many segments as `split`, of lengths that differ by one at most, the longer first."""
        n = self.n
        parts = max(1, -(-n // size))
        low, longer = divmod(n, parts)
        i, edge = F.col("i"), longer * (low + 1)
        seg = F.when(i < edge, F.floor(i / (low + 1))).otherwise(longer + F.floor((i - edge) / max(low, 1)))
        return self.df.select(seg.alias("seg"), F.when(i < edge, i % (low + 1)).otherwise((i - edge) % max(low, 1)).alias("j"), "v")

    def shaped(self, *shape: int) -> DataFrame:
        """(d0, d1, ..., v): positions in an array of any number of dimensions; values go round if there are too few. One
        dimension may be -1, as long as the values make it."""
        given = 1
        for k in shape:
            given *= k if k != -1 else 1
        shape = tuple(-(-self.n // given) if k == -1 else k for k in shape)
        total, step = 1, []
        for k in reversed(shape):
            step.append(total)
            total *= k
        places = [(F.floor(F.col("i") / x) % k).alias(f"d{j}") for j, (k, x) in enumerate(zip(shape, reversed(step), strict=True))]
        return self.take(total).df.select(*places, "v")

    def reshape(self, rows: int, columns: int) -> DataFrame:
        """(r, c, v) row by row; values go round if there are too few."""
        whole = self.take(rows * columns)
        return whole.df.select(F.floor(F.col("i") / columns).alias("r"), (F.col("i") % columns).alias("c"), "v")

    def grade_up(self) -> Vector:
        """Positions in ascending order of values, ties by position."""
        got = dense_index(self.df.withColumnRenamed("i", "was"), F.col("v").asc(), F.col("was").asc())
        return Vector(got.select("i", F.col("was").alias("v")), self._n)

    def grade_down(self) -> Vector:
        """The reverse of grade_up, so ties come in descending position."""
        got = dense_index(self.df.withColumnRenamed("i", "was"), F.col("v").desc(), F.col("was").desc())
        return Vector(got.select("i", F.col("was").alias("v")), self._n)

    def sort(self) -> Vector:
        """Index by grade, fused: one ordering and no join."""
        got = dense_index(self.df.withColumnRenamed("i", "was"), F.col("v").asc(), F.col("was").asc())
        return Vector(got.select("i", "v"), self._n)

    def top(self, k: int) -> DataFrame:
        """The k largest values with their positions; ties to the larger position."""
        return self.df.orderBy(F.col("v").desc(), F.col("i").desc()).limit(k)

    def group(self) -> DataFrame:
        """(v, places): ascending positions of each value; the list is the result, so a value must fit a task."""
        return self.df.groupBy("v").agg(F.array_sort(F.collect_list("i")).alias("places"))

    def unique(self) -> DataFrame:
        """(v, i): distinct values with the position of their first appearance."""
        return self.df.groupBy("v").agg(F.min("i").alias("i"))

    def matches(self, other: Vector) -> DataFrame:
        """One row: 1 if all values are the same in the same places."""
        o = other.df.select("i", F.col("v").alias("w"), F.lit(1).alias("there"))
        both = self.df.withColumn("here", F.lit(1)).join(o, "i", "full")
        same = F.col("here").isNotNull() & F.col("there").isNotNull() & F.col("v").eqNullSafe(F.col("w"))
        return both.agg(F.coalesce(F.min(same.cast("long")), F.lit(1).cast("long")).alias("v"))

    # folds

    def over(self, how: str, neutral=None) -> DataFrame:
        """Left fold by + * & | - % as one aggregate; of an empty vector it is undefined (or the neutral value)."""
        v, head = F.col("v"), F.min_by("v", "i")
        made = {"+": F.sum(v), "*": F.product(v), "&": F.min(v), "|": F.max(v), "-": 2 * head - F.sum(v), "%": head * head / F.product(v)}[how]
        if neutral is not None:
            made = {"+": lambda: neutral + F.coalesce(made, F.lit(0)), "*": lambda: neutral * F.coalesce(made, F.lit(1)), "&": lambda: F.least(made, F.lit(neutral)), "|": lambda: F.greatest(made, F.lit(neutral)), "-": lambda: neutral - F.coalesce(F.sum(v), F.lit(0)), "%": lambda: neutral / F.coalesce(F.product(v), F.lit(1.0))}[how]()
        return self.df.agg(made.alias("v"))

    def scan(self, how: str, seed=None) -> Vector:
        """Running fold by + * & | - %, in two steps: totals of blocks, then a running fold inside each block. A running
        difference is the first value less the running sum of the others, a running quotient likewise."""
        if how in "-%" and seed is None:
            turned = self.map_index(lambda i, v: F.when(i == 0, v).otherwise(-v if how == "-" else 1.0 / v))
            return turned.scan("+" if how == "-" else "*")
        if seed is not None:
            first = self.df.sparkSession.range(1).select(F.lit(-1).cast("long").alias("i"), F.lit(seed).alias("v"))
            df = first.union(self.df).select((F.col("i") + 1).alias("i"), "v")
            return Vector(df).scan(how)
        fold = {"+": F.sum, "*": F.product, "&": F.min, "|": F.max}[how]
        both = {"+": lambda a, b: F.coalesce(a, F.lit(0)) + b, "*": lambda a, b: F.coalesce(a, F.lit(1.0)) * b, "&": F.least, "|": F.greatest}[how]
        block = F.floor(F.col("i") / BLOCK)
        totals = self.df.groupBy(block.alias("b")).agg(fold("v").alias("t"))
        ahead = totals.select("b", fold("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)).alias("ahead"))
        inside = self.df.select("i", block.alias("b"), fold("v").over(Window.partitionBy(block).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).alias("w"))
        return Vector(inside.join(ahead, "b").select("i", both(F.col("ahead"), F.col("w")).alias("v")), self._n)

    def sliding(self, k: int, f: Callable[[Column], Column], name: str = "v") -> DataFrame:
        """f over each full window of k values, by its last position; blocks overlap by k - 1 rows, so none is global."""
        w = Window.partitionBy("_b").orderBy("i").rowsBetween(1 - k, 0)
        spread = overlapping(self.df, k, "i")
        return spread.select("i", "_b", "_home", f(F.col("v")).over(w).alias(name), F.count("*").over(w).alias("n")).where(f"_home = _b and n = {k}").select("i", name)
