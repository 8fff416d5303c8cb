"""Session settings that the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "colvane", **conf: str) -> SparkSession:
    """A session with ANSI errors, adaptive plans, UTC and last-wins maps."""
    base = {"spark.sql.adaptive.enabled": "true", "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.mapKeyDedupPolicy": "LAST_WIN"}
    builder = SparkSession.builder.appName(name)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where none is set, a temporary one on a local master, and
    an error on any other."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = getattr(shared_dir, "own", None)
        if not path:
            path = shared_dir.own = tempfile.mkdtemp(prefix="checkpoints-")
    return path.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts lineage and fixes its partitions."""
    path = f"{shared_dir(df.sparkSession)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
