"""File events as streams: merging by path with state, and incremental index maintenance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.events import merge_python
from tessera.operators.index import build_postings, number_rows
from tessera.tables import children, delete, exists, mark


def read_events(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Events (path, ts, seq, event) from JSON files as they arrive."""
    return spark.readStream.schema("path string, ts timestamp, seq long, event string").option("maxFilesPerTrigger", per_trigger).json(folder)


def merged_stream(events: DataFrame, period_ms: int = 7000) -> DataFrame:
    """One row (path, event, n) for each path and flush period: the period begins with a path's
    first event and ends by the clock; then the merged event is given out and the state dropped."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            event, n = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "event": [event], "n": [n]})
            return
        rows = pd.concat(list(batches)).sort_values("seq")
        event, n = state.get if state.exists else (None, 0)
        for new in rows["event"]:
            event = new if event is None else merge_python(event, new)
            n += 1
        fresh = not state.exists
        state.update((event, n))
        if fresh:
            state.setTimeoutDuration(period_ms)
        yield pd.DataFrame({"path": [], "event": [], "n": []}).astype({"path": str, "event": str, "n": "int64"})

    return events.groupBy("path").applyInPandasWithState(fold, "path string, event string, n long", "event string, n long", "update", GroupStateTimeout.ProcessingTimeTimeout)


#: Micro-batches after which their changes are merged into one table.
MERGE_EVERY = 20

REMOVALS = "('Removed', 'RenamedOld')"


def keep_index(events: DataFrame, texts: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, merge_every: int = MERGE_EVERY):
    """Run a stream of merged events (path, event[, file_id]) into an index under ``folder``.

    Each micro-batch writes what it changes: postings of its files that are not removed, and which
    files it touched, whose older postings count no more.  Paths without an id get one after the
    greatest ever issued, and keep it until they are removed.  A repeated batch writes its own
    changes again.  Every ``merge_every`` batches all is merged into one table.
    ``texts`` gives (file_id, text) of files (path, file_id) to be indexed.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, f"{folder}/delta-{number:08d}"
        if exists(spark, f"{folder}/base-{number:08d}/_DONE"):
            return  # merged already: a repeated batch has nothing to add
        last = batch.select("path", "event", *(["file_id"] if "file_id" in batch.columns else []))
        known = paths_of(spark, folder, number)
        if "file_id" not in batch.columns:
            known = known.withColumnRenamed("file_id", "known_id").drop("removed")
            both = last.join(known.where("known_id is not null"), "path", "left")
            top = known.agg(F.coalesce(F.max("top"), F.lit(-1)).alias("top"))
            new = both.where(f"known_id is null and event not in {REMOVALS}").select("path").distinct()
            given = number_rows(new, ["path"]).crossJoin(F.broadcast(top)).select("path", (F.col("top") + F.col("n")).alias("new_id"))  # one row
            last = both.join(given, "path", "left").select("path", "event", F.coalesce("known_id", "new_id").alias("file_id")).where("file_id is not null")
        gone = F.col("event").isin("Removed", "RenamedOld")
        last.select("path", F.col("file_id").cast("long").alias("file_id"), gone.alias("removed")).write.mode("overwrite").parquet(f"{at}/touched")
        touched = spark.read.parquet(f"{at}/touched")
        fresh = texts(touched.where("not removed").select("path", "file_id").distinct())
        build_postings(fresh).write.mode("overwrite").parquet(f"{at}/postings")
        mark(spark, f"{at}/_DONE")
        if (number + 1) % merge_every == 0:
            merge_changes(spark, folder, number)

    return events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def _parts(spark: SparkSession, folder: str, number: int) -> tuple[int, list[int]]:
    """The newest merged table before batch ``number`` (-1: none) and the complete changes after it."""
    names = children(spark, folder)
    whole = lambda kind: [int(n.rsplit("-", 1)[1]) for n in names if n.startswith(kind) and exists(spark, f"{folder}/{n}/_DONE")]
    base = max((n for n in whole("base-") if n < number), default=-1)
    return base, [n for n in sorted(whole("delta-")) if base < n < number]


def _history(spark: SparkSession, folder: str, number: int, kind: str, schema: str) -> DataFrame:
    """Rows of one kind from the merged table and all changes, with the batch they come from."""
    base, deltas = _parts(spark, folder, number)
    out = spark.createDataFrame([], schema).withColumn("batch", F.lit(-1))
    for name, n in [(f"base-{base:08d}", base)] * (base >= 0) + [(f"delta-{n:08d}", n) for n in deltas]:
        out = out.unionByName(spark.read.schema(schema).parquet(f"{folder}/{name}/{kind}").withColumn("batch", F.lit(n)))
    return out


PATHS = "path string, file_id long, removed boolean"


def paths_of(spark: SparkSession, folder: str, number: int = 1 << 40) -> DataFrame:
    """(path, file_id, top): live paths, and in rows without a path the greatest id so far."""
    seen = _history(spark, folder, number, "touched", PATHS)
    last = seen.where("path is not null").groupBy("path").agg(F.max(F.struct("batch", "removed", "file_id")).alias("l"))
    live = last.where("not l.removed").select("path", F.col("l.file_id").alias("file_id"), F.lit(None).cast("long").alias("top"))
    return live.unionByName(seen.agg(F.max("file_id").alias("top")).select(F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("file_id"), "top"))


def postings_of(spark: SparkSession, folder: str, number: int = 1 << 40) -> DataFrame:
    """(word, file_id, cnt) as of before batch ``number``; empty where there is no index yet."""
    all_of = _history(spark, folder, number, "postings", "word string, file_id long, cnt long")
    touched = _history(spark, folder, number, "touched", PATHS).groupBy("file_id").agg(F.max("batch").alias("last"))
    return all_of.join(touched, "file_id", "left").where("last is null or batch = last").select("word", "file_id", "cnt")


def merge_changes(spark: SparkSession, folder: str, number: int) -> None:
    """Write all up to batch ``number`` as one table and delete what it replaces."""
    at = f"{folder}/base-{number:08d}"
    old, deltas = _parts(spark, folder, number + 1)
    postings_of(spark, folder, number + 1).repartitionByRange("word").sortWithinPartitions("word", "file_id").write.mode("overwrite").parquet(f"{at}/postings")
    live = paths_of(spark, folder, number + 1)
    tops = live.where("top is not null").select(F.lit(None).cast("string").alias("path"), F.col("top").alias("file_id"), F.lit(True).alias("removed"))
    live.where("path is not null").select("path", "file_id", F.lit(False).alias("removed")).unionByName(tops).write.mode("overwrite").parquet(f"{at}/touched")
    mark(spark, f"{at}/_DONE")
    for name in [f"base-{old:08d}"] * (old >= 0) + [f"delta-{n:08d}" for n in deltas]:
        delete(spark, f"{folder}/{name}")
