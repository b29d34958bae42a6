"""Connected components by minimum labels and pointer jumping, in DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, c): every vertex with an edge, and the smallest vertex it can reach.

    Each round takes the smallest label among neighbours and then the label's own label, so the number of rounds
    follows the logarithm of a component's diameter. Every round is written to the shared folder."""
    pairs = edges.where(F.col(a) != F.col(b)).select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = written(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy("v").agg(F.least("v", F.min("u")).alias("c")), "labels")
    while True:
        near = both.join(labels.select(F.col("v").alias("u"), "c"), "u").groupBy("v").agg(F.min("c").alias("n"))
        lower = labels.join(near, "v").select("v", F.col("c").alias("was"), F.least("c", "n").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("next"))
        after = written(
            lower.join(jump, "c", "left").select("v", "was", F.least("c", F.coalesce("next", "c")).alias("c")), "labels"
        )
        changed = after.where("c <> was").limit(1).count()
        labels = after.select("v", "c")
        if not changed:
            return labels
