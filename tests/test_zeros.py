"""Values that round to zero keep their sign, as in SQL."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tests.compare import connection


@pytest.mark.parametrize("name", ["fft", "over_each", "over_join", "language_demean"])
def test_signs_of_zeros_in_lists(spark, tmp_path, name):
    rows = [(1, [-0.00002] + [0.0] * 63), (2, [0.00002] + [0.0] * 63), (3, [0.5] * 32 + [-0.25] * 32)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).toPandas().to_parquet(tmp_path / "embeddings.parquet")
    got = sorted(tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect())
    want = sorted(connection(str(tmp_path)).execute(entry.oracle_sql()[name]).fetchall())
    assert repr([list(r) for r in got]) == repr([list(r) for r in want])
    assert "-0.0," in repr(got[0])
