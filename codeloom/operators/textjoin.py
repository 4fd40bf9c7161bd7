"""Joins of texts by containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import dropped, written


def contained(needles: DataFrame, texts: DataFrame, size: int = 3) -> DataFrame:
    """needle and text for every needle (needle) that stands in a text (text); each different one once, empty needles in none.

    A needle can only stand where all its runs of ``size`` characters do (it is itself the run, if it is shorter), so
    the rarest of them, counted over all texts, is its key; the join is on that alone, and then the whole is checked.
    """
    needles = written(needles.select("needle").where("needle <> ''").distinct(), "needles")
    texts = written(texts.select("text").where("text <> ''").distinct(), "texts")
    runs = lambda c, k: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(F.col(c)) - k + 1), lambda i: F.substr(F.col(c), i, k)))
    lengths = [r["k"] for r in needles.select(F.least(F.length("needle"), F.lit(size)).alias("k")).distinct().collect()]  # at most size rows
    if not lengths:
        return needles.withColumn("text", F.col("needle"))
    held = None
    for k in lengths:
        part = texts.where(F.length("text") >= k).select("text", F.explode(runs("text", F.lit(k))).alias("run"))
        held = part if held is None else held.unionAll(part)
    held = written(held, "runs")
    counts = held.groupBy("run").agg(F.count("*").alias("held"))
    own = needles.withColumn("k", F.least(F.length("needle"), F.lit(size)))
    own = own.select("needle", F.explode(runs("needle", F.col("k"))).alias("run")).join(counts, "run", "left")
    keys = own.groupBy("needle").agg(F.min(F.struct(F.coalesce("held", F.lit(0)).alias("held"), "run")).alias("m")).where("m.held > 0").select("needle", F.col("m.run").alias("run"))
    out = written(keys.join(held, "run").where(F.contains("text", "needle")).select("needle", "text"), "contained")
    dropped(needles, texts, held)
    return out
