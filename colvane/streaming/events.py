"""Event streams: upserts by micro-batch, subscriptions, rolling indicators, and windows with late data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from colvane.operators.table import latest
from colvane.operators.vector import dense_index, overlapping


def timer(stream: DataFrame, seconds: float, f: Callable[[DataFrame, int], object], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Calls f with each micro-batch every so many seconds; stop() cancels. once: all that is there, then end."""
    writer = stream.writeStream.foreachBatch(f).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{seconds} seconds")).start()


def matches(pattern, symbol):
    """Whether a subscription is for the symbol: exact, or a prefix that ends in *."""
    return F.when(pattern.endswith("*"), symbol.startswith(F.left(pattern, F.length(pattern) - 1))).otherwise(pattern == symbol)


def fan_out(events: DataFrame, subscriptions: DataFrame, symbol: str) -> DataFrame:
    """One row for each event and subscription (client, pattern) that wants it; symbols are matched once each."""
    wanted = events.select(symbol).distinct().join(subscriptions, matches(F.col("pattern"), F.col(symbol)))
    return events.join(wanted, symbol)


def bollinger(df: DataFrame, by: str, order: str, value: str, k: int = 20, width: float = 2.0) -> DataFrame:
    """Mean and bands of the last k values of each key. Keys are cut into blocks of positions that overlap by k - 1 rows,
    so a frequent key is no single task."""
    w = Window.partitionBy("_b", by).orderBy("_i").rowsBetween(1 - k, 0)
    mean, sd = F.avg(value).over(w), F.stddev_pop(value).over(w)
    made = overlapping(dense_index(df, by, order, name="_i"), k).select("*", mean.alias("mid"), (mean - width * sd).alias("low"), (mean + width * sd).alias("high"))
    return made.where("_home = _b").drop("_b", "_home", "_i")


class KeyedSink:
    """foreachBatch target: a keyed table in versions. Of all rows of a key, stored ones too, the last in `order` stays,
    so a late row replaces none that is newer. Each batch is applied once, even if it is retried: it reads the version
    before its own, and only versions older than that are deleted."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: list[str]):
        self.spark, self.path, self.keys, self.order = spark, path.rstrip("/"), keys, order

    def version(self, k: int) -> str:
        return f"{self.path}/v{k:08d}"

    def __call__(self, batch: DataFrame, k: int) -> None:
        if k:
            batch = batch.sparkSession.read.parquet(self.version(k - 1)).unionByName(batch)
        latest(batch, self.keys, self.order).write.mode("overwrite").parquet(self.version(k))
        if k > 1:
            old = self.spark._jvm.org.apache.hadoop.fs.Path(self.version(k - 2))
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)


def tumbling(df: DataFrame, ts: str, length: str, by: str, late: str | None = None) -> DataFrame:
    """Counts and sums of fixed windows; `late` sets a watermark (the column must then be a TIMESTAMP)."""
    df = df.withWatermark(ts, late) if late else df
    return df.groupBy(F.window(ts, length).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sliding(df: DataFrame, ts: str, length: str, slide: str, by: str) -> DataFrame:
    return df.groupBy(F.window(ts, length, slide).alias("w"), by).agg(F.avg("value").alias("mean"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "mean", "n")


def sessions(df: DataFrame, ts: str, gap: str, by: str) -> DataFrame:
    return df.groupBy(F.session_window(ts, gap).alias("w"), by).agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")
