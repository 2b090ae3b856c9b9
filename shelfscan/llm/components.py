"""Connected components of a graph of links, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .support import discard, stored


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node; component is its smallest reachable node.

    Each round, a node takes the smallest label among its neighbours' and its
    own, then its label's label, until nothing changes: the labels of a path
    shrink by halves.  A round aggregates within tasks before it shuffles, and
    its written labels cut the lineage.  No links give no rows.
    """
    one_way = links.select(F.col(a).alias("node"), F.col(b).alias("other")).filter("node <> other")
    edges = stored(one_way.union(one_way.select("other", "node")).distinct(), "links")
    written = stored(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels")
    labels = written
    while True:
        near = (edges.join(labels.withColumnRenamed("node", "other"), "other")
                .groupBy("node").agg(F.min("component").alias("near")))
        hooked = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("low"))
        up = labels.select(F.col("node").alias("low"), F.col("component").alias("top"))
        moved = stored(hooked.join(up, "low", "left").select(
            "node", F.least("low", F.coalesce("top", "low")).alias("component"),
            (F.least("low", F.coalesce("top", "low")) < F.col("component")).alias("moved")), "labels")
        discard(written)
        written, labels = moved, moved.select("node", "component")
        if not moved.filter("moved").limit(1).count():
            discard(edges)
            return labels
