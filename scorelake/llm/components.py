"""Connected components by smallest labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.session import cut


def connected_components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """id, root: the smallest id that edges (a, b) reach from each id that they name.

    Each round takes the smallest label of the neighbours (a minimum with map-side combine, so a hub costs no more), then
    that label's own label. Rounds are written to the checkpoint folder; labels never leave the executors.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("root")))
    for _ in range(most_rounds):
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("root").alias("m"))
        new = labels.join(near, labels["id"] == near["a"]).select("id", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("id").alias("u"), F.col("root").alias("above"))
        jumped = cut(new.join(up, new["root"] == up["u"], "left").select("id", "old", F.coalesce("above", "root").alias("root")))
        labels = jumped.select("id", "root")
        if jumped.where("old <> root").isEmpty():
            return labels
    raise RuntimeError(f"components not found in {most_rounds} rounds")
