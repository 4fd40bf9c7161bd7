"""File changes as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..engine import frame_operator
from ..plans.dialect import Dialect


def watched(spark: SparkSession, folder: str, *, pattern: str = "*", excluded: str | None = None, per_batch: int = 10_000) -> DataFrame:
    """Files as they come to a folder and those below it, as a stream of path, ts (time of change), event_id (the same in milliseconds), event_type, n_bytes and text.

    pattern is a glob of names, excluded a regular expression of paths that are left out; a batch takes at most
    per_batch files, the rest come with the next ones. debounced(watched(...), "path", watermark="1 minute") gives
    the last change of each burst. A store that rewrites files in place shows a change by a new name or by S02.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(folder)
    if excluded:
        files = files.where(~F.col("path").rlike(excluded))
    return files.select("path", F.col("modificationTime").alias("ts"), F.unix_millis("modificationTime").alias("event_id"), F.lit("change").alias("event_type"), F.col("length").alias("n_bytes"), F.col("content").cast("string").alias("text"))


def debounced(events: DataFrame, key: str = "path", delay: str = "5 minutes", *, watermark: str | None = None, order: str = "event_id") -> DataFrame:
    """Of each burst of a key's events (gaps shorter than the delay) only the last. Works on a table and, with a watermark, on a stream in append mode."""
    if watermark:
        events = events.withWatermark("ts", watermark)
    bursts = events.groupBy(F.session_window("ts", delay).alias("w"), F.col(key))
    last = bursts.agg(F.max(F.struct("ts", order, "event_type")).alias("last"), F.count("*").alias("n"))
    return last.select(F.col(key), F.col(f"last.{order}").alias(order), F.col("last.event_type").alias("event_type"), F.col("last.ts").alias("ts"), "n")


def reindex(changes: DataFrame, parse: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """Parse each batch of changed files (path, language, text, deleted) into a table partitioned by batch; a batch that runs again writes the same partition again, so results are exactly once. Deletions are rows without symbols."""

    def store(batch: DataFrame, number: int) -> None:
        live = parse(batch.where("NOT deleted")).withColumn("deleted", F.lit(False))
        gone = batch.where("deleted").select("path").withColumn("deleted", F.lit(True))
        live.unionByName(gone, allowMissingColumns=True).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return changes.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(target: DataFrame) -> DataFrame:
    """The symbols in force: those of each path's latest batch, without deleted paths."""
    latest = target.groupBy("path").agg(F.max("batch").alias("batch"))
    return target.join(latest, ["path", "batch"]).where("NOT deleted").drop("deleted", "batch")


class Progress(StreamingQueryListener):
    """One line for each batch, handed to a sink."""

    def __init__(self, sink: Callable[[dict], None]):
        self.sink = sink

    def onQueryStarted(self, event) -> None:
        self.sink({"phase": "started"})

    def onQueryProgress(self, event) -> None:
        self.sink({"phase": "progress", "batch": event.progress.batchId, "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.sink({"phase": "complete"})


def _t01_sql(d: Dialect) -> str:
    return """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 5 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        b AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g)
        SELECT user_id, arg_max(event_id, row(ts, event_id)) AS event_id, arg_max(event_type, row(ts, event_id)) AS event_type, max(ts) AS ts, count(*) AS n FROM b GROUP BY user_id, burst"""


@frame_operator("events", _t01_sql)
def t01_debounce(t: dict[str, DataFrame]) -> DataFrame:
    return debounced(t["events"], "user_id")
