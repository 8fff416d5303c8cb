"""The catalogue of queries: each a function of (spark, folder) with its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colvane.operators.vector import Vector, dense_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Events in order, as SQL.
E = "(select row_number() over (order by event_id) - 1 as i, value as v, event_id, event_type, user_id, ts from events)"
N = "(select count(*) from events)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def sql_query(name: str, text: str, tables: str, twin: str | None = None) -> None:
    """A query that is SQL text over named tables."""
    from colvane.operators.table import Database

    query(name, twin or text)(lambda spark, d: Database.of_folder(spark, d, tables.split())(text))


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events_vector(spark: SparkSession, d: str) -> DataFrame:
    """Events with dense positions."""
    return dense_index(t(spark, d, "events").select("event_id", "event_type", "user_id", "ts", F.col("value").alias("v")), "event_id")


def ev(spark: SparkSession, d: str) -> Vector:
    return Vector(events_vector(spark, d))


def r4(c, name: str):
    return F.round(c, 4).alias(name)


def rounded(c):
    """To four places, with the sign of values that become zero (-0.00001 is -0.0) as in SQL: in lists it tells rows apart."""
    return F.abs(F.round(c, 4)) * F.signum(c)


def iv(v: Vector) -> DataFrame:
    """Positions and rounded values."""
    return v.df.select("i", r4(F.col("v"), "v"))
