"""Expressions of the array language against their values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from colvane.language import Language, LanguageError

CASES = {
    "2*3+4": 14, "(2*3)+4": 10, "10-3-2": 9, "1+[1 2 3]": [2, 3, 4], "[1 2 3]+[10 20 30]": [11, 22, 33], "[[1 2] [3 4]]*2": [[2, 4], [6, 8]],
    "-5": -5, "-[1 2]": [-1, -2], "3-1": 2, "7%2": 3.5, "7:%2": 3, "-7!5": -2, "2^10": 1024.0, "3|5": 5, "3&5": 3, "1=1": 1, "[1 2]=[1 3]": [1, 0], '"a"<"b"': 1, "2>1": 1,
    "!5": [0, 1, 2, 3, 4], "&[0 1 2]": [1, 2, 2], "*[7 8]": 7, "_2.7": 2, "$12": "12", "<[3 1 2]": [1, 2, 0], ">[3 1 2]": [0, 2, 1], ",5": [5], "~0": 1, "~5": 0,
    "?[1 2 1 3]": [1, 2, 3], "%2": 0.5, "|[1 2 3]": [3, 2, 1], '|"abc"': "cba", "#[1 2 3]": 3, '#"abcd"': 4, "#-7": 7, "+[[1 2] [3 4]]": [[1, 3], [2, 4]], "^[1 2 3]": [3], "^[[1 2] [3 4]]": [2, 2], "@5": 1, "@[1]": 0, "=[1 2 1]": [[0, 2], [1]],
    "2#[1 2 3]": [1, 2], "-2#[1 2 3]": [2, 3], "5#[1 2]": [1, 2, 1, 2, 1], "1_[1 2 3]": [2, 3], "1:+[1 2 3]": [3, 1, 2], "2:#[1 2 3 4 5]": [[1, 2], [3, 4], [5]], "[2 2]:^!4": [[0, 1], [2, 3]], "[2 2 2]:^!8": [[[0, 1], [2, 3]], [[4, 5], [6, 7]]],
    "[1 2],[3]": [1, 2, 3], "1,[2 3]": [1, 2, 3], '"ab","cd"': "abcd", "[5 6 7]@1": 6, "[5 6 7]@[2 0]": [7, 5], '"hello"@1': "e", "[1 2 1]?1": [0, 2], '"abab"?"ab"': [0, 2], "[1 2 3]:=[9 0 2]": [9, 2, 9], "[[1 2] [3 4]]:-[9 1 0]": [[1, 2], [9, 4]], "[[1 2] [3 4]]:@[1 0]": 3, "[2]:_[1 2 3]": [[1, 2], [3]], '0:$"12"': 12, '5$"ab"': "ab   ", "[1 2]~[1 2]": 1, "[1 2]~[1 3]": 0,
    "+/[1 2 3 4]": 10, "*/[1 2 3 4]": 24, "-/[10 2 3]": 5, "%/[8 2 2]": 2.0, "|/[3 9 4]": 9, "100+/[1 2]": 103, "+\\[1 2 3]": [1, 3, 6], "-\\[10 2 3]": [10, 8, 5], "|\\[1 3 2]": [1, 3, 3], "5+\\[1 2]": [5, 6, 8],
    "+/'[[1 2] [3 4]]": [3, 7], "#'[[1] [2 3]]": [1, 2], "{x*x}'[1 2 3]": [1, 4, 9], "[1 2]{x+2*y}'[10 20]": [21, 42], "10-:\\[1 2 3]": [9, 8, 7], "10-:/[1 2 3]": [-9, -8, -7], "-:'[1 4 9]": [-3, -5], "{x+y}@'[10 20]": [10, 21], ",/[[1 2] [3]]": [1, 2, 3],
    "3{x*2}:*1": 8, "3{x*2}\\*1": [1, 2, 4, 8], "{x<100}{x*2}:~1": 128, "{x<20}{x*2}\\~1": [1, 2, 4, 8, 16], "{_x%2}\\~9": [9, 4, 2, 1, 0],
    ":[1;2;3]": 2, ":[0;2;3]": 3, ":[0;1:|1;5;7]": 5, "{:[x>0;1:|x<0;-1;0]}'[5 -3 0]": [1, -1, 0], "[;1+1;2*3]": [2, 6],
    "a::3;a*a": 9, "f::{x+y};f(1;2)": 3, "f::{x-y};g::f(;2);g(10)": 8, "f::{[t];t::x*2;t+1};f(5)": 11, ':"note" 1+1': 2, "sq::{x*x};+/sq'!4": 14, "avg::{(+/x)%#x};avg([1 2 3 4])": 2.5, "{x+y}/[1 2 3]": 6, "(+/[1 2]),5": [3, 5], '"say ""hi"""': 'say "hi"', ":foo": "foo",
}


def test_expressions(spark):
    made = {k: Language().compile(k).col for k in CASES}
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(made.values()))).first()
    wrong = {k: (row[i], want) for i, (k, want) in enumerate(CASES.items()) if row[i] != want}
    assert wrong == {}


@pytest.mark.parametrize("text", ["1+", "nothere", "{x", "[1 2", "1 2", "(1+2", ":[1;2]", "[1 [2]]"])
def test_errors(text):
    with pytest.raises((LanguageError, IndexError)):
        Language().compile(text)


def test_over_columns_and_host_functions(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 2.0]), (2, [3.0, 4.0])], "k long, xs array<double>")
    got = Language(df).select("k", "norm", "(+/x*x)^0.5", "xs is x")
    assert [tuple(r) for r in got.orderBy("k").collect()] == [(1, 3.0), (2, 5.0)]
    lang = Language(df).define("half", lambda c: c / 2, 1).builtin("sqrt").load("colvane.functions.scalars", "plus", "reciprocal")
    assert [r["v"] for r in lang.select("k", "v", "half(xs)").orderBy("k").collect()] == [[0.5, 1.0, 1.0], [1.5, 2.0]]
    assert lang.select("k", "v", "sqrt(plus(k;8))").orderBy("k").first()["v"] == 3.0
    assert df.select(Language(df).compile("k+1").col.alias("v")).agg(F.sum("v")).first()[0] == 5
