"""The engine's entry points: one call to bring the index up to date, one to search it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.operators import index, journal
from tessera.operators.search import search, with_paths
from tessera.sources import files
from tessera.tables import discard, materialise

#: Changed files up to which they are read by their paths; more are read by a scan of all folders.
FEW_FILES = 10_000


def refresh(spark: SparkSession, folder: str, config: EngineConfig) -> dict[str, int]:
    """Bring the index under ``folder`` up to date with the files of the settings' folders, and return
    how many were added, updated, removed and left the same.

    A listing without contents is compared with the saved one; only added and updated files are
    read and indexed; their postings and the kept ones become the next version, which readers see
    at once when it is complete.  Where nothing changed no version is written.
    """
    listed = files.scan_files(spark, config.dirs, config.extensions, config.exclude, config.min_size, content=False)
    new = materialise(listed.select("path", "mtime", "size").dropDuplicates(["path"]), "listing")
    saved = index.load_current(spark, folder)
    old = saved[1] if saved else spark.createDataFrame([], index.FILES)
    diff = materialise(index.snapshot_diff(old, new), "diff")
    counts = {r["change"]: r["n"] for r in diff.groupBy("change").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows
    counts = {k: counts.get(k, 0) for k in ("added", "updated", "removed", "same")}
    if saved is None or counts["added"] + counts["updated"] + counts["removed"]:
        due = diff.where("change in ('added', 'updated')").select("path", "file_id")
        texts = _contents(spark, due, counts["added"] + counts["updated"], config)
        postings = saved[0] if saved else spark.createDataFrame([], "word string, file_id long, cnt long")
        version = (index.current_version(spark, folder) or 0) + 1
        index.save(index.apply_refresh(postings, diff, texts), index.files_after(old, new, diff), folder, version)
        index.drop_versions(spark, folder)
    discard(new, diff)
    return counts


def _contents(spark: SparkSession, due: DataFrame, n: int, config: EngineConfig) -> DataFrame:
    """(file_id, text) of the files ``due`` (path, file_id)."""
    if not n:
        return spark.createDataFrame([], "file_id long, text string")
    if n <= FEW_FILES:
        read = spark.read.format("binaryFile").load([r["path"] for r in due.collect()]).select("path", "content")
    else:
        read = files.scan_files(spark, config.dirs, config.extensions, config.exclude, config.min_size).select("path", "content")
    return read.join(due, "path").select("file_id", files.decode_oem("content").alias("text"))


def answer(spark: SparkSession, folder: str, requests: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(request_id, file_id, hits, relevance, rank, path) from the saved index under ``folder``."""
    saved = index.load_current(spark, folder)
    if saved is None:
        raise FileNotFoundError(f"no index under {folder}")
    postings, known = saved
    return with_paths(search(postings, requests, config), known)


def answer_journal(spark: SparkSession, folder: str, request: str, archive: DataFrame, key: str, order_by: list[str], config: EngineConfig = EngineConfig()) -> DataFrame:
    """(rank, json): ranked journal rows of one request to the saved index."""
    requests = spark.createDataFrame([(1, request)], "request_id int, request string")
    hits = answer(spark, folder, requests, config).select("rank", "path", "relevance")
    return journal.result_json(journal.search_journal(hits, archive, key, order_by))


def journal_json(archive: DataFrame, kind: int, condition: str, order_by: list[str], limit: int | None = None) -> DataFrame:
    """(rank, json): rows of one journal that meet a condition, as result objects in the order of shards
    and then ``order_by``.  A condition with a limit of its own is refused: the limit is a
    parameter, and the text is parsed by Spark as one expression."""
    found = journal.as_texts(journal.journal_query(archive, F.expr(condition), order_by, limit))
    ranked = index.number_rows(found, ["shard_prio", *order_by])
    return journal.result_json(journal.result_row(ranked, kind, F.col("n").cast("int").alias("rank")))


def keep_fresh(spark: SparkSession, folder: str, config: EngineConfig, seconds: float, rounds: int | None = None) -> list[dict[str, int]]:
    """``refresh`` every so many seconds, for ever or for some rounds."""
    import itertools
    import time

    out = []
    for i in itertools.count() if rounds is None else range(rounds):
        if i:
            time.sleep(seconds)
        counts = refresh(spark, folder, config)
        out = [*out[-99:], counts]
    return out
