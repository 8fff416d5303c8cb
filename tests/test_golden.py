"""Operators on literal lists: expected values follow from each operator's definition."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from colvane.functions import dist as P
from colvane.functions import grad as G
from colvane.functions import mathx as M
from colvane.functions import scalars as S
from colvane.operators import nested as A
from colvane.operators.table import Database, Table
from colvane.operators.vector import Vector
from colvane.sources.store import KeyValueStore, TableStore


def arr(*v):
    return F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<int>")


CASES = {
    "rotate right": (lambda: A.rotate(arr(1, 2, 3, 4, 5), 2), [4, 5, 1, 2, 3]),
    "rotate left": (lambda: A.rotate(arr(1, 2, 3, 4, 5), -2), [3, 4, 5, 1, 2]),
    "rotate empty": (lambda: A.rotate(arr(), 1), []),
    "take": (lambda: A.take(arr(1, 2, 3), 2), [1, 2]),
    "take last": (lambda: A.take(arr(1, 2, 3), -2), [2, 3]),
    "take round": (lambda: A.take(arr(1, 2, 3), 5), [1, 2, 3, 1, 2]),
    "take round back": (lambda: A.take(arr(1, 2, 3), -5), [2, 3, 1, 2, 3]),
    "drop": (lambda: A.drop(arr(1, 2, 3), 1), [2, 3]),
    "drop last": (lambda: A.drop(arr(1, 2, 3), -1), [1, 2]),
    "drop all": (lambda: A.drop(arr(1, 2, 3), 7), []),
    "split": (lambda: A.split(arr(1, 2, 3, 4), 3), [[1, 2, 3], [4]]),
    "cut": (lambda: A.cut(arr(0, 1, 2, 3, 4), arr(2, 2, 4)), [[0, 1], [], [2, 3], [4]]),
    "reshape": (lambda: A.reshape(arr(1, 2, 3), 2, 2), [[1, 2], [3, 1]]),
    "transpose": (lambda: A.transpose(F.array(arr(1, 2), arr(3, 4), arr(5, 6))), [[1, 3, 5], [2, 4, 6]]),
    "grade up": (lambda: A.grade_up(arr(3, 1, 2, 1)), [1, 3, 2, 0]),
    "grade down": (lambda: A.grade_down(arr(3, 1, 2, 1)), [0, 2, 3, 1]),
    "group": (lambda: A.group(arr(1, 2, 1, 3, 1, 2, 3)), [[0, 2, 4], [1, 5], [3, 6]]),
    "unique": (lambda: A.unique(arr(3, 1, 3, 2)), [3, 1, 2]),
    "where": (lambda: A.where(arr(0, 1, 1, 0)), [1, 2]),
    "expand": (lambda: A.expand(arr(1, 0, 2)), [0, 2, 2]),
    "find": (lambda: A.find(arr(1, 2, 1), F.lit(1)), [0, 2]),
    "amend": (lambda: A.amend(arr(1, 2, 3), F.lit(9), arr(0, 2)), [9, 2, 9]),
    "over": (lambda: A.over(arr(1, 2, 3, 4), lambda a, x: a - x), -8),
    "over empty": (lambda: A.over(arr(), lambda a, x: a + x), None),
    "scan": (lambda: A.scan(arr(1, 2, 3), lambda a, x: a + x), [1, 3, 6]),
    "scan neutral": (lambda: A.scan(arr(1, 2, 3), lambda a, x: a + x, F.lit(10)), [10, 11, 13, 16]),
    "each pair": (lambda: A.each_pair(arr(1, 4, 9), lambda a, b: b - a), [3, 5]),
    "each two": (lambda: A.each2(arr(1, 2, 3), arr(10, 20), lambda a, b: a + b), [11, 22]),
    "iterate": (lambda: A.iterate(3, F.lit(1), lambda v: v * 2), 8),
    "scan iterate": (lambda: A.scan_iterate(3, F.lit(1), lambda v: v * 2), [1, 2, 4, 8]),
    "scan while": (lambda: A.scan_while(F.lit(1), lambda v: v < 10, lambda v: v * 2, 9), [1, 2, 4, 8]),
    "while": (lambda: A.while_(F.lit(1), lambda v: v < 10, lambda v: v * 2, 9), 16),
    "converge": (lambda: F.round(A.converge(F.lit(2.0), lambda v: (v + 2 / v) / 2), 6), 1.414214),
    "enumerate none": (lambda: A.enumerate_(F.lit(0)), []),
    "intersection": (lambda: A.intersection(arr(1, 2, 2, 3), arr(2, 3)), [2, 2, 3]),
    "power set": (lambda: A.power_set(arr(1, 2)), [[], [1], [2], [1, 2]]),
    "find text": (lambda: S.find_text(F.lit("abbbbbbbc"), "bbb"), [1, 2, 3, 4, 5]),
    "overwrite": (lambda: S.overwrite_text(F.lit("abc"), "XY", 2), "abXY"),
    "pad": (lambda: S.pad(F.lit("abc"), -5), "  abc"),
    "pad short": (lambda: S.pad(F.lit("abc"), 2), "abc"),
    "char": (lambda: S.char(F.lit(945)), "α"),
    "remainder": (lambda: S.remainder(F.lit(-7), F.lit(5)), -2),
    "int divide": (lambda: S.int_divide(F.lit(-7), F.lit(5)), -1),
    "int divide zero": (lambda: S.int_divide(F.lit(7), F.lit(0)), None),
    "int divide large": (lambda: S.int_divide(F.lit(2**62 + 1), F.lit(1)), 2**62 + 1),
    "divide zero": (lambda: S.divide(F.lit(1), F.lit(0)), None),
    "form": (lambda: S.form_int(F.lit("1.5")), None),
    "unique chars": (lambda: S.unique_chars(F.lit("mississippi")), "misp"),
    "gcd": (lambda: M.gcd(F.lit(12), F.lit(18)), 6),
    "matmul": (lambda: M.matmul(F.array(arr(1, 2), arr(3, 4)), F.array(arr(5, 6), arr(7, 8))), [[19.0, 22.0], [43.0, 50.0]]),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    made, want = CASES[name]
    assert spark.range(1).select(made().alias("v")).first()["v"] == want


def test_special_functions(spark):
    row = spark.range(1).select(
        M.gamma(F.lit(5.0)).alias("gam"), M.gamma_p(F.lit(1.0), F.lit(2.0)).alias("p"), M.rbeta(F.lit(0.5), F.lit(2.0), F.lit(2.0)).alias("b"),
        P.student_cdf(F.lit(2.015), 5.0).alias("t"), P.chi_square_cdf(F.lit(11.0705), 5.0).alias("x2"), P.fisher_cdf(F.lit(3.6331), 4.0, 9.0).alias("f"), P.normal_qf(F.lit(0.975)).alias("q"), P.chi_square_qf(F.lit(0.95), 5.0).alias("xq"),
    ).first()
    want = {"gam": 24, "p": 1 - math.exp(-2), "b": 0.5, "t": 0.95, "x2": 0.95, "f": 0.95, "q": 1.959964, "xq": 11.0705}
    for k, v in want.items():
        assert row[k] == pytest.approx(v, rel=1e-4), k
    assert P.student_qf(5.0) and spark.range(1).select(P.student_qf(5.0)(F.lit(0.95))).first()[0] == pytest.approx(2.015, abs=1e-3)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=12), st.integers(-15, 15))
def test_nested_equals_distributed(spark, xs, k):
    """The two encodings agree on the operators both have."""
    d = Vector(spark.createDataFrame(list(enumerate(xs)), "i long, v long"))
    n = spark.createDataFrame([(xs,)], "a array<long>")
    for name in ("rotate", "take", "drop"):
        if name == "drop" and abs(k) > len(xs):
            continue
        got = [r["v"] for r in sorted(getattr(d, name)(k).df.collect(), key=lambda r: r["i"])]
        assert got == n.select(getattr(A, name)(F.col("a"), k).alias("v")).first()["v"], (name, xs, k)
    assert [r["v"] for r in sorted(d.sort().df.collect(), key=lambda r: r["i"])] == sorted(xs)
    assert [r["v"] for r in sorted(d.scan("+").df.collect(), key=lambda r: r["i"])] == [sum(xs[: i + 1]) for i in range(len(xs))]


def test_split_balanced(spark):
    v = Vector.enumerate(spark, 4)
    assert sorted((r["seg"], r["v"]) for r in v.split_balanced(3).collect()) == [(0, 0), (0, 1), (1, 2), (1, 3)]


def test_table_script(spark):
    x = Table.of(spark, [(1, 2, 3), (2, 3, 4), (3, 4, 5)], "a long, b long, c long").insert((4, 5, 6)).insert((4, 5, 6))
    assert x.count() == 5
    keyed = x.index("a")
    assert keyed.count() == 4
    assert keyed.insert((4, 5, 6)).count() == 4
    assert sorted(map(tuple, keyed.insert((4, 6, 7)).df.collect()))[-1] == (4, 6, 7)
    assert keyed.insert([(9, 1, 1), (9, 2, 2)]).df.where("a = 9").collect()[0]["b"] == 2
    assert keyed.without_index().insert((4, 6, 7)).count() == 5
    assert x.index("a", "b").insert((4, 6, 7)).count() == 5
    with pytest.raises(ValueError):
        x.insert((1, 2))
    with pytest.raises(ValueError):
        x.index("z")
    with pytest.raises(ValueError):
        keyed.index("a")
    assert "*a b c" in keyed.show()
    db = Database(spark, {"T": x})
    assert Database.squeeze(db("select count(*) from T")) == 5 and db.schema == {"T": ["a", "b", "c"]}


def test_stores(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "t"), ["a"])
    assert store.get("k") is None
    store.set("k", spark.createDataFrame([(1, 1), (2, 2)], "a long, b long"))
    store.set("k", spark.createDataFrame([(2, 9), (3, 3)], "a long, b long"))
    assert sorted(map(tuple, store.get("k").collect())) == [(1, 1), (2, 2), (3, 3)]
    plain = TableStore(spark, str(tmp_path / "p"))
    plain.set("k", spark.createDataFrame([(1, 1), (2, 2)], "a long, b long"))
    plain.set("k", spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "a long, b long"))
    assert plain.get("k").count() == 3
    kv = KeyValueStore(spark, str(tmp_path / "kv"))
    kv.set("a/b", {"x": [1, 2]})
    kv.set("a/b", 5)
    assert kv.get("a/b") == 5 and kv.get("none") is None


def test_gradients(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i + 3) for i in range(20)], "x double, y double")
    loss = (G.par("w") * G.col("x") + G.par("b") - G.col("y")) ** 2 + G.ln(G.exp(G.par("w")) + 1) / 10
    assert G.gradcheck(df, loss, {"w": 0.5, "b": 0.1})
    path = G.descend(df, (G.par("w") * G.col("x") / 10 + G.par("b") - G.col("y") / 10) ** 2, {"w": 0.0, "b": 0.0}, 0.3, 25).orderBy("step").collect()
    assert path[-1]["loss"] < path[0]["loss"] / 50
