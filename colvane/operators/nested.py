"""Nested vectors: one row holds a whole list. All operators are higher-order functions on array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def enumerate_(n: Column) -> Column:
    return F.when(n <= 0, F.array().cast("array<long>")).otherwise(F.sequence(F.lit(0).cast("long"), F.greatest(n, F.lit(1)).cast("long") - 1))


def _places(a: Column) -> Column:
    return enumerate_(F.size(a))


def first(a):
    return F.try_element_at(a, F.lit(1))


def reverse(a):
    return F.reverse(a)


def rotate(a: Column, k: int) -> Column:
    n = F.size(a)
    return F.transform(_places(a), lambda i: F.get(a, F.pmod(i - k, n).cast("int")))


def take(a: Column, k: int) -> Column:
    """First k or last -k; goes round beyond the length."""
    n = F.size(a)
    start = F.lit(0) if k >= 0 else F.pmod(n + k, F.greatest(n, F.lit(1)))
    return F.when(n == 0, a).otherwise(F.transform(enumerate_(F.lit(abs(k))), lambda i: F.get(a, F.pmod(i + start, n).cast("int"))))


def drop(a: Column, k: int) -> Column:
    return F.slice(a, F.lit(k + 1), F.greatest(F.size(a) - k, F.lit(0))) if k >= 0 else F.slice(a, F.lit(1), F.greatest(F.size(a) + k, F.lit(0)))


def at(a: Column, index: Column) -> Column:
    return F.transform(index, lambda j: F.get(a, j.cast("int")))


def at_depth(a: Column, *index: int) -> Column:
    for j in index:
        a = F.get(a, F.lit(j))
    return a


def amend(a: Column, value: Column, index: Column) -> Column:
    return F.transform(a, lambda x, i: F.when(F.array_contains(index, i), value).otherwise(x))


def amend_depth(a: Column, value: Column, *index: int) -> Column:
    """value at one place of a nested list, given by any number of indices."""
    if not index:
        return value
    return F.transform(a, lambda row, p: F.when(p == index[0], amend_depth(row, value, *index[1:])).otherwise(row))


def cut(a: Column, places: Column) -> Column:
    """Segments before each place; places ascend."""
    low = F.concat(F.array(F.lit(0)), places)
    high = F.concat(places, F.array(F.size(a)))
    return F.zip_with(low, high, lambda x, y: F.slice(a, x + 1, y - x))


def split(a: Column, k: int) -> Column:
    return F.transform(enumerate_(F.ceil(F.size(a) / k)), lambda g: F.slice(a, (g * k + 1).cast("int"), k))


def reshape(a: Column, rows: int, columns: int) -> Column:
    n = F.size(a)
    return F.transform(enumerate_(F.lit(rows)), lambda r: F.transform(enumerate_(F.lit(columns)), lambda c: F.get(a, F.pmod(r * columns + c, n).cast("int"))))


def transpose(m: Column) -> Column:
    return F.transform(enumerate_(F.size(F.get(m, 0))), lambda j: F.transform(m, lambda row: F.get(row, j.cast("int"))))


def shape(m: Column) -> Column:
    """[rows, columns] of a matrix; [rows] of a ragged list."""
    width = F.size(F.get(m, 0))
    return F.when(F.forall(m, lambda r: F.size(r) == width), F.array(F.size(m), width)).otherwise(F.array(F.size(m)))


def grade_up(a):
    pairs = F.array_sort(F.transform(a, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    return F.transform(pairs, lambda e: e["i"])


def grade_down(a):
    return F.reverse(grade_up(a))


def group(a: Column) -> Column:
    """Position lists of each distinct value, in the order of values."""
    return F.transform(F.array_sort(F.array_distinct(a)), lambda v: find(a, v))


def find(a: Column, value: Column) -> Column:
    return F.filter(_places(a), lambda i: F.get(a, i.cast("int")) == value)


def where(a: Column) -> Column:
    return F.filter(_places(a), lambda i: F.get(a, i.cast("int")) != 0)


def expand(a: Column) -> Column:
    return F.flatten(F.transform(a, lambda n, i: F.array_repeat(i, n.cast("int"))))


def unique(a):
    return F.array_distinct(a)


def match(a, b):
    return a.eqNullSafe(b).cast("long")


def concat(a, b):
    return F.concat(a, b)


def each(a: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(a, f)


def each_index(a, f):
    return F.transform(a, lambda x, i: f(i, x))


def each2(a, b, f):
    n = F.least(F.size(a), F.size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), f)


def each_left(a, b, f):
    return F.transform(b, lambda y: f(a, y))


def each_right(a, b, f):
    return F.transform(b, lambda y: f(y, a))


def each_pair(a, f):
    n = F.greatest(F.size(a) - 1, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(a, F.lit(2), n), f)


def over(a: Column, f, start: Column | None = None) -> Column:
    """Left fold; without a start the first element starts, and an empty list is undefined."""
    return F.aggregate(a, start, f) if start is not None else F.when(F.size(a) > 0, F.aggregate(drop(a, 1), first(a), f))


def scan(a: Column, f, start: Column | None = None) -> Column:
    """All intermediate folds."""
    rest = a if start is not None else drop(a, 1)
    seed = F.array(start) if start is not None else F.slice(a, F.lit(1), F.least(F.size(a), F.lit(1)))
    return F.aggregate(rest, seed, lambda acc, x: F.concat(acc, F.array(f(F.try_element_at(acc, F.lit(-1)), x))))


def deep(a: Column, depth: int, f) -> Column:
    """f of every atom of a list of that depth."""
    return f(a) if depth == 0 else F.transform(a, lambda x: deep(x, depth - 1, f))


def deep2(a: Column, b: Column, depth_a: int, depth_b: int, f) -> Column:
    """f of the atoms of two lists, place by place; an atom goes with every atom of the other side."""
    if depth_a and depth_b:
        return F.zip_with(a, b, lambda x, y: deep2(x, y, depth_a - 1, depth_b - 1, f))
    return deep(a, depth_a, lambda x: f(x, b)) if depth_a else deep(b, depth_b, lambda y: f(a, y))


def over_join(a):
    return F.flatten(a)


def iterate(n: int, x: Column, f) -> Column:
    return F.aggregate(enumerate_(F.lit(n)), x, lambda acc, _: f(acc))


def scan_iterate(n: int, x: Column, f) -> Column:
    """x, f(x), f(f(x)) ...: n + 1 values."""
    return F.aggregate(enumerate_(F.lit(n)), F.array(x), lambda acc, _: F.concat(acc, F.array(f(F.element_at(acc, -1)))))


def within(end: Column, done, limit: int) -> Column:
    """`end` where it is done or undefined; else an error that names the limit."""
    return F.transform(F.array(end), lambda v: F.when(v.isNull() | done(v), v).otherwise(F.raise_error(F.lit(f"not done after {limit} steps; give a larger limit"))))[0]


def converge(x: Column, f, limit: int = 100, tolerance: float = 1e-12) -> Column:
    """f until it stops changing; an error if it hasn't after `limit` times."""
    still = lambda v: F.abs(f(v) - v) <= tolerance * F.abs(v)
    end = F.aggregate(enumerate_(F.lit(limit)), x, lambda acc, _: F.when(still(acc), acc).otherwise(f(acc)))
    return within(end, still, limit)


def scan_converge(x: Column, f, limit: int = 100) -> Column:
    """All values until f stops changing; an error if it hasn't after `limit` times."""

    def step(acc, _):
        new = f(F.element_at(acc, -1))
        return F.when(new == F.element_at(acc, -1), acc).otherwise(F.concat(acc, F.array(new)))

    end = F.aggregate(enumerate_(F.lit(limit)), F.array(x), step)
    return within(end, lambda v: F.coalesce(f(F.element_at(v, -1)) == F.element_at(v, -1), F.lit(True)), limit)


def while_(x: Column, test, f, limit: int = 1000) -> Column:
    """f as long as test holds: the first value for which it fails; an error if it holds after `limit` steps."""
    end = F.aggregate(enumerate_(F.lit(limit)), x, lambda acc, _: F.when(test(acc), f(acc)).otherwise(acc))
    return within(end, lambda v: ~F.coalesce(test(v), F.lit(False)), limit)


def scan_while(x: Column, test, f, limit: int = 1000) -> Column:
    """Values while test holds; the one that fails is left out; an error if it holds after `limit` steps."""
    empty = F.when(test(x), F.array(x)).otherwise(F.slice(F.array(x), 1, 0))

    def step(acc, _):
        new = f(F.try_element_at(acc, F.lit(-1)))
        return F.when((F.size(acc) > 0) & test(new), F.concat(acc, F.array(new))).otherwise(acc)

    end = F.aggregate(enumerate_(F.lit(limit)), empty, step)
    return within(end, lambda v: (F.size(v) == 0) | ~F.coalesce(test(f(F.try_element_at(v, F.lit(-1)))), F.lit(False)), limit)


def dict_get(m, k):
    return F.try_element_at(m, k)


def dict_put(m, k, v):
    return F.map_concat(F.map_filter(m, lambda x, _: x != k), F.create_map(k, v))


def dict_remove(m, k):
    return F.map_filter(m, lambda x, _: x != k)


def each_dict(m, f):
    return F.transform(F.map_entries(m), lambda e: f(e["key"], e["value"]))


# sets as lists


def union(a, b):
    return F.array_distinct(F.concat(a, b))


def intersection(a: Column, b: Column) -> Column:
    """Elements of a that b has, as often as b asks for them."""
    return F.flatten(F.transform(b, lambda y: F.filter(a, lambda x: x == y)))


def power_set(a: Column) -> Column:
    n = F.size(a)
    return F.transform(enumerate_(F.pow(F.lit(2.0), n).cast("long")), lambda m: F.filter(a, lambda x, i: F.shiftright(m, 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0))


def depth(kind: str) -> int:
    """Nesting of a Spark type name."""
    return kind.count("array<")
