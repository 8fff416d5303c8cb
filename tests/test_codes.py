"""Huffman codes and splines."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colvane.functions import codes
from colvane.functions.mathx import spline


def test_huffman(spark):
    df = spark.createDataFrame([("abracadabra",), ("",), (None,), ("zé",)], "s string")
    code = codes.huffman(codes.character_counts(df, "s"))
    assert sorted(code, key=lambda c: len(code[c]))[0] == "a"
    assert not any(x != y and y.startswith(x) for x in code.values() for y in code.values())
    bits = df.select("s", codes.encode(F.col("s"), code).alias("b"))
    assert all(r["s"] == r["d"] for r in bits.select("s", codes.decode(F.col("b"), code).alias("d")).collect())
    assert spark.range(1).select(codes.encode(F.lit("q"), code).alias("v")).first()["v"] is None
    assert codes.huffman(spark.createDataFrame([("a", 5)], "c string, n long")) == {"a": "0"}
    assert codes.huffman(spark.createDataFrame([], "c string, n long")) == {}


def test_spline_meets_its_knots(spark):
    knots = [(1, 2.0), (2, 1.5), (4, 1.25), (5, 1.2), (8, 1.125), (10, 1.1)]
    df = spark.createDataFrame([(float(x),) for x, _ in knots] + [(0.0,), (11.0,), (None,)], "x double")
    got = {r["x"]: (r["a"], r["b"]) for r in df.select("x", spline(F.col("x"), knots).alias("a"), spline(F.col("x"), knots, True).alias("b")).collect()}
    for x, y in knots:
        assert got[float(x)] == (pytest.approx(y), pytest.approx(y))
    assert got[0.0] == (None, pytest.approx(2.0)) and got[11.0] == (None, pytest.approx(1.1)) and got[None] == (None, None)
