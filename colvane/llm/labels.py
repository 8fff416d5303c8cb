"""A bounded, deterministic sample of labelled rows for training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colvane.llm.common import held_out


def training_rows(docs: DataFrame, labels: DataFrame, target: str, modulus: int, remainder: int, limit: int) -> DataFrame:
    """(doc_id, text, y) of at most `limit` labelled documents that aren't held out.

    The ids of lowest hash are taken, so the choice depends on ids alone and any input gives a sample over all of it.
    A document with several labels has the largest, an id with several texts the smallest text; rows of null doc_id or
    label are no training rows.
    """
    y = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("y"))
    some = y.where(~held_out(F.col("doc_id"), modulus, remainder)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
