"""Connected components of a table of links, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colvane.llm.common import forget, stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): the smallest id reachable. Minimum labels with pointer jumping.

    Each round reads and writes a table of one row an id and deletes the one before; counts of changed labels alone
    reach the driver. A hot id is harmless: labels of neighbours are reduced before the shuffle. The table returned is
    the caller's to delete.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    now = stored(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("component")), "labels")
    while True:
        labels = now.select("id", "component")
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near, labels.id == near.a, "left").select("id", F.col("component").alias("was"), F.least("component", "near").alias("c"))
        jump = labels.select(F.col("id").alias("c"), F.col("component").alias("further"))
        new = stored(low.join(jump, "c", "left").select("id", "was", F.least("c", F.coalesce("further", "c")).alias("component")), "labels")
        forget(now)
        now = new
        if new.where("component <> was").isEmpty():
            forget(both)
            out = new.select("id", "component")
            out.stored_at = new.stored_at
            return out
