"""Keyed tables, stores, databases and step limits."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colvane.operators import nested as A
from colvane.operators.table import Database, Table
from colvane.operators.vector import Vector, running
from colvane.sources.store import TableStore, merge


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_a_batch_has_one_row_a_key(spark):
    t = Table.of(spark, [(1, 10), (None, 5)], "k long, v long").index("k")
    batch = spark.createDataFrame([(1, 11), (1, 12), (None, 6), (2, 1)], "k long, v long")
    assert rows(t.insert(batch).df) == rows(spark.createDataFrame([(1, 12), (None, 6), (2, 1)], "k long, v long"))
    assert rows(t.insert([(1, 12), (1, 11)]).df) == rows(spark.createDataFrame([(1, 11), (None, 5)], "k long, v long"))


def test_merge_by_place(spark, tmp_path):
    old = spark.createDataFrame([(0, 1), (1, 2)], "i long, v long")
    new = spark.createDataFrame([(2, 1), (0, 9), (1, 8)], "i long, v long")
    assert rows(merge(old, new, None, "i")) == [(0, 1), (1, 2), (2, 1)]
    assert rows(merge(old.select("v"), spark.createDataFrame([(9,), (8,), (1,)], "v long"), None)) == [(1,), (1,), (2,)]
    store = TableStore(spark, str(tmp_path), position="i")
    store.set("a", old)
    assert rows(store.set("a", new)) == [(0, 1), (1, 2), (2, 1)]


def test_databases_leave_views_alone(spark):
    spark.range(3).createOrReplaceTempView("x")
    assert Database(spark, {"x": spark.range(5), "y": spark.range(2)})("select count(*) as n from x, y").first()["n"] == 10
    assert spark.table("x").count() == 3 and not spark.catalog.tableExists("y")
    spark.catalog.dropTempView("x")


def test_limits_are_errors(spark):
    def one(c):
        return spark.range(1).select(c.alias("v")).first()["v"]

    zero = F.lit(0.0)
    assert one(A.while_(zero, lambda v: v < 50, lambda v: v + 1)) == 50
    assert one(A.while_(zero, lambda v: v < 5000, lambda v: v + 1, 6000)) == 5000
    assert one(A.scan_while(F.lit(1), lambda v: v < 5, lambda v: v * 2)) == [1, 2, 4]
    assert one(A.scan_converge(F.lit(5), lambda v: F.floor(v / 2).cast("int"))) == [5, 2, 1, 0]
    for c in (
        A.while_(zero, lambda v: v < 5000, lambda v: v + 1),
        A.converge(F.lit(1.0), lambda v: v * 0.99),
        A.scan_converge(F.lit(1.0), lambda v: v + 1),
        A.scan_while(zero, lambda v: v < 5000, lambda v: v + 1),
    ):
        with pytest.raises(Exception, match="larger limit"):
            one(c)


def test_running_folds_cross_blocks(spark, monkeypatch):
    from colvane.operators import vector

    monkeypatch.setattr(vector, "BLOCK", 4)
    df = spark.createDataFrame([("a" if i % 3 else None, i, (i * 7) % 11) for i in range(40)], "k string, i long, v long")
    got = {(r["k"], r["i"]): r["run"] for r in running(df, "k", "i", "v").collect()}
    for (k, i), run in got.items():
        assert run == max((j * 7) % 11 for j in range(i + 1) if ("a" if j % 3 else None) == k)
    assert len(got) == 40


def test_shapes_and_cycles(spark):
    v = Vector.enumerate(spark, 7)
    assert rows(v.shaped(2, -1, 2)) == sorted([(i // 4, i // 2 % 2, i % 2, i % 7) for i in range(8)], key=repr)
    assert rows(v.split([1, 2])) == sorted([(0, 0, 0), (1, 0, 1), (1, 1, 2), (2, 0, 3), (3, 0, 4), (3, 1, 5), (4, 0, 6)], key=repr)
    assert [r["v"] for r in sorted(v.scan("-").df.collect(), key=lambda r: r["i"])] == [0, -1, -3, -6, -10, -15, -21]
    nest = F.array(F.array(F.array(F.lit(1), F.lit(2))))
    assert spark.range(1).select(A.amend_depth(nest, F.lit(9), 0, 0, 1).alias("v")).first()["v"] == [[[1, 9]]]
