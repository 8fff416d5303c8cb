"""Tables with keys, upserts, and named databases queried in SQL. All are immutable: changes give new tables."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


class Table:
    def __init__(self, df: DataFrame, keys: tuple[str, ...] = ()):
        self.df, self.keys = df, keys

    @classmethod
    def of(cls, spark: SparkSession, rows: list, columns: str) -> Table:
        return cls(spark.createDataFrame(rows, columns))

    @property
    def schema(self) -> list[str]:
        return self.df.columns

    def column(self, name: str) -> DataFrame | None:
        return self.df.select(name) if name in self.df.columns else None

    def with_column(self, name: str, value) -> Table:
        return Table(self.df.withColumn(name, value), self.keys)

    def index(self, *keys: str) -> Table:
        """Declares keys; duplicate whole rows are dropped, rows with equal keys are not."""
        if self.keys:
            raise ValueError("the table has keys already")
        missing = [k for k in keys if k not in self.df.columns]
        if missing or not keys:
            raise ValueError(f"no such columns: {missing}")
        return Table(self.df.dropDuplicates(), keys)

    def without_index(self) -> Table:
        return Table(self.df)

    def insert(self, rows: list | DataFrame) -> Table:
        """Appends; a keyed table is updated where keys match, null keys too. Inside one batch the last row of a key wins;
        a DataFrame has no order, so of its rows with one key the largest wins."""
        spark = self.df.sparkSession
        if isinstance(rows, DataFrame):
            new, order = rows, []
            if len(new.columns) != len(self.df.columns):
                raise ValueError(f"{len(self.df.columns)} columns are needed")
            new = new.toDF(*self.df.columns)
        else:
            rows = [tuple(r) for r in (rows if rows and isinstance(rows[0], (list, tuple)) else [rows])]
            if any(len(r) != len(self.df.columns) for r in rows):
                raise ValueError(f"{len(self.df.columns)} values are needed")
            new, order = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], StructType([*self.df.schema.fields, StructField("_order", LongType())])), ["_order"]
        return Table(upsert(self.df, new, self.keys, order) if self.keys else self.df.unionByName(new.drop("_order")), self.keys)

    def count(self) -> int:
        return self.df.count()

    def show(self, n: int = 10) -> str:
        """The first rows as text; * marks keys."""
        rows = self.df.orderBy(*self.keys).limit(n + 1).collect() if self.keys else self.df.limit(n + 1).collect()
        head = " ".join(f"*{c}" if c in self.keys else c for c in self.df.columns)
        lines = [head, *(" ".join(map(str, r)) for r in rows[:n])]
        if len(rows) > n:
            lines += ["...", f"rows={self.df.count()}"]
        return "\n".join(lines)


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] | list[str], order: list[str] = ()) -> DataFrame:
    """Rows of new replace those of old with equal keys (null equals null); others are added. Keys are made unique in
    new: `order` ranks its rows and the last wins, without an order the largest row."""
    row = F.struct(*old.columns)
    new = new.groupBy(*keys).agg((F.max_by(row, F.struct(*order)) if order else F.max(row)).alias("r")).select("r.*")
    known = new.select(*(F.col(k).alias(f"_new_{k}") for k in keys))
    same = functools.reduce(operator.and_, (F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys))
    return old.join(known, same, "left_anti").unionByName(new)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("r")).select("r.*")


class Database:
    """Named tables; calling it runs SQL text over them."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame | Table]):
        self.spark = spark
        self.tables = {k: v.df if isinstance(v, Table) else v for k, v in tables.items()}

    @classmethod
    def of_folder(cls, spark: SparkSession, path: str, names: list[str]) -> Database:
        return cls(spark, {n: spark.read.parquet(f"{path}/{n}.parquet") for n in names})

    @property
    def schema(self) -> dict[str, list[str]]:
        return {k: v.columns for k, v in self.tables.items()}

    def __call__(self, text: str) -> DataFrame:
        """Tables are bound to the text's own names while it is resolved; the session's views of those names are as before."""
        catalog = self.spark.catalog
        views = {v.name: self.spark.table(v.name) for v in catalog.listTables() if v.isTemporary and v.name in self.tables}
        try:
            for k, v in self.tables.items():
                v.createOrReplaceTempView(k)
            return self.spark.sql(text)
        finally:
            for k in self.tables:
                catalog.dropTempView(k)
            for k, v in views.items():
                v.createOrReplaceTempView(k)

    @staticmethod
    def squeeze(df: DataFrame, limit: int = 1_000_000):
        """A collected result with single rows and columns unwrapped; refuses more rows than `limit`."""
        rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError("the result is too large to collect")
        values = [list(r) for r in rows]
        if len(df.columns) == 1:
            values = [r[0] for r in values]
            return values[0] if len(values) == 1 else values
        return values[0] if len(values) == 1 else values


def asof(left: DataFrame, right: DataFrame, by: str, on: str, value: str, name: str) -> DataFrame:
    """For each left row the value of the last right row of the same key at or before it: one union and one window."""
    a = left.withColumn("_v", F.lit(None).cast(right.schema[value].dataType)).withColumn("_side", F.lit(1))
    b = right.select(by, on, F.col(value).alias("_v")).withColumn("_side", F.lit(0))
    w = Window.partitionBy(by).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True)
    return both.withColumn(name, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_v", "_side")
