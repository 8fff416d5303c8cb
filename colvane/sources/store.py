"""Table store and key-value store on Parquet, range reads, CSV text and delimited measurements."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colvane.session import stored


class TableStore:
    """A folder of Parquet tables by key. Setting merges: rows whose key is there already are kept as they are. Without
    keys, rows are told by their place, as in `merge`."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str] | None = None, position: str | None = None):
        self.spark, self.path, self.keys, self.position = spark, path.rstrip("/"), keys, position

    def _versions(self, key: str) -> list[str]:
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{key}")
        fs = fs_path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(fs_path):
            return []
        found = [s.getPath() for s in fs.listStatus(fs_path)]
        done = [p for p in found if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return [str(p) for p in sorted(done, key=lambda p: p.getName())]

    def get(self, key: str) -> DataFrame | None:
        """The table, or None if there is none."""
        versions = self._versions(key)
        return self.spark.read.parquet(versions[-1]) if versions else None

    def set(self, key: str, df: DataFrame) -> DataFrame:
        """Writes a new version beside the old one, so a failed write leaves the old one whole (one writer a key)."""
        old = self.get(key)
        merged = df if old is None else merge(old, df, self.keys, self.position)
        merged.write.parquet(f"{self.path}/{key}/v{len(self._versions(key)):08d}-{uuid.uuid4().hex[:8]}")
        return self.get(key)


def merge(old: DataFrame, new: DataFrame, keys: list[str] | None, position: str | None = None) -> DataFrame:
    """Old rows, and new ones whose key is not there. Without keys, places are keys: those rows of new are added whose
    place, in ascending order of the column `position`, is past the old length. That column need not be in old. Without
    it the frame's own order counts, partition after partition, as a list or a sorted frame has it."""
    if keys:
        return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(old.columns))
    from colvane.operators.vector import dense_index

    if position is None:
        new, position = new.withColumn("_order", F.monotonically_increasing_id()), "_order"
    n = old.count()
    return old.unionByName(dense_index(new, position, name="_i").where(F.col("_i") >= n).select(old.columns))


class KeyValueStore:
    """JSON values by key; setting overwrites. Nothing is ever unpickled."""

    def __init__(self, spark: SparkSession, path: str):
        self.tables = TableStore(spark, path)

    def set(self, key: str, value) -> None:
        spark = self.tables.spark
        text = json.dumps(value)
        n = len(self.tables._versions(key))
        spark.createDataFrame([(key, text)], "key string, value string").write.parquet(f"{self.tables.path}/{key}/v{n:08d}-{uuid.uuid4().hex[:8]}")

    def get(self, key: str, missing=None):
        df = self.tables.get(key)
        return missing if df is None else json.loads(df.first()["value"])


def time_range(df: DataFrame, column: str, low, high) -> DataFrame:
    """Rows between two times, both included; None leaves an end open; the filter reaches the scan."""
    df = df if low is None else df.where(F.col(column) >= low)
    return df if high is None else df.where(F.col(column) <= high)


def position_range(indexed: DataFrame, low: int | None = None, high: int | None = None, name: str = "i") -> DataFrame:
    """Rows at positions low .. high - 1; None leaves an end open."""
    indexed = indexed if low is None else indexed.where(F.col(name) >= low)
    return indexed if high is None else indexed.where(F.col(name) < high)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("quote", '"').option("escape", "\\").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("quote", '"').option("escape", "\\").option("header", True).schema(schema).csv(path)


def csv_roundtrip(df: DataFrame) -> DataFrame:
    """Each row to CSV text and back, in place."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)
    return df.select(F.from_csv(F.to_csv(F.struct(*df.columns)), schema).alias("r")).select("r.*")


def read_measurements(spark: SparkSession, path: str) -> DataFrame:
    """station;temperature lines."""
    return spark.read.option("sep", ";").schema("station string, temp double").csv(path)


def station_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Minimum, mean, maximum and count of each station; partial sums are made before the shuffle."""
    return df.groupBy(by).agg(F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"), F.count("*").alias("n"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").text(path)


def parse_json_field(c, path: str, kind: str):
    return F.get_json_object(c, path).try_cast(kind)


__all__ = ["KeyValueStore", "TableStore", "csv_roundtrip", "merge", "position_range", "read_csv", "read_lines", "read_measurements", "station_stats", "stored", "time_range", "write_csv", "write_lines"]
