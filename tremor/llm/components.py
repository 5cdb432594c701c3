"""Connected components of a link table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def connected_components(links: DataFrame) -> DataFrame:
    """links (a, b) of one comparable type -> (node, component), component the smallest node reached.

    Every round each node takes the smallest label among its neighbours and then its
    label's label, so a chain of n nodes needs about log n rounds.  Rounds are cut with
    Parquet tables in the shared folder.  Self links keep their node; nulls drop out;
    an empty table gives an empty table.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    both = keep(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = (
            both.join(label.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("component").alias("near"))
        )
        low = label.join(near, "node").select("node", F.least("component", "near").alias("low"), F.col("component").alias("old"))
        top = label.select(F.col("node").alias("low"), F.col("component").alias("top"))
        moved = keep(
            low.join(top, "low", "left").select("node", F.least("low", F.coalesce("top", "low")).alias("component"), "old"), "labels"
        )
        label = moved.select("node", "component")
        if not moved.where("component <> old").limit(1).count():
            return label
