"""Set operators on small tables of distinct elements: products, combinations, permutations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs, which is the operator itself: for small sets."""
    return a.crossJoin(b)


def tuples(df: DataFrame, name: str, k: int, how: str) -> DataFrame:
    """k-tuples by self-joins: 'comb' (ascending), 'combr' (not descending), 'perm' (distinct), 'enum' (all)."""
    out = df.select(F.col(name).alias(f"{name}1"))
    for j in range(2, k + 1):
        new, last = F.col(f"{name}{j}"), F.col(f"{name}{j - 1}")
        test = {"comb": last < new, "combr": last <= new, "enum": F.lit(True)}.get(how)
        if test is None:
            test = F.lit(True)
            for q in range(1, j):
                test = test & (F.col(f"{name}{q}") != new)
        out = out.join(df.select(F.col(name).alias(f"{name}{j}")), test)
    return out
