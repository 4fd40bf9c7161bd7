"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", *, max_rounds: int = 100) -> DataFrame:
    """id and component (the smallest id reachable) of every endpoint of undirected edges.

    Each round takes the smallest label among a vertex's neighbours (partial
    aggregation before the shuffle, so a hub is no hot key), hands it on to the
    vertex that was the old label as well, and then follows the label's own label.
    So a long chain settles in a number of rounds that grows with the logarithm of
    its length. Labels are written between rounds. Edges with a null
    end are ignored; self-loops and repeated edges do no harm.
    """
    pairs = edges.select(edges[f"`{a}`"].cast("long").alias("u"), edges[f"`{b}`"].cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    both = written(pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("id")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("id", "v"), "v").groupBy(F.col("u").alias("id")).agg(F.min("component").alias("near"))
        near = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("near"))
        hooked = near.select("id", "near").unionAll(near.where("near < component").select(F.col("component").alias("id"), "near")).groupBy("id").agg(F.min("near").alias("low"))
        low = labels.join(hooked, "id").select("id", "component", F.least("component", "low").alias("low"))
        jump = labels.select(F.col("id").alias("low"), F.col("component").alias("next"))
        moved = low.join(jump, "low", "left").select("id", F.least("low", "next").alias("component"), (F.least("low", "next") != F.col("component")).alias("changed"))
        moved = written(moved, "labels")
        dropped(labels)
        labels = moved.select("id", "component")
        labels._codeloom_path = moved._codeloom_path
        if moved.where("changed").isEmpty():
            dropped(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
