"""The inverted index as tables: postings (word, file_id, cnt) and files (path, mtime, size, file_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.tables import children, delete, exists, mark, materialise


def build_postings(docs: DataFrame, file_id: str = "file_id", text: str = "text") -> DataFrame:
    """(word, file_id, cnt): term frequencies.  Words of one file meet in partial sums before the shuffle."""
    each = docs.select(F.col(file_id).alias("file_id"), F.explode(T.words(F.col(text))).alias("word"))
    return each.groupBy("word", "file_id").agg(F.count(F.lit(1)).alias("cnt"))


def word_lookup(postings: DataFrame, words: list[str]) -> DataFrame:
    return postings.where(F.col("word").isin([w.translate(str.maketrans(T.LOWER, T.UPPER)) for w in words]))


def file_words(postings: DataFrame) -> DataFrame:
    """(file_id, words): the forward index; a list has one file's distinct words."""
    return postings.groupBy("file_id").agg(F.array_sort(F.collect_list("word")).alias("words"))


def stats(postings: DataFrame, vocabulary: DataFrame | None = None) -> DataFrame:
    """One row: unique_words, total_postings, total_files, empty_postings, memory_bytes (6 a posting, 24 a list)."""
    lists = postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if vocabulary is not None:
        lists = vocabulary.select("word").distinct().join(lists, "word", "left").fillna(0, ["n"])
    totals = lists.agg(
        F.count(F.lit(1)).alias("unique_words"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_postings"), F.count(F.when(F.col("n") == 0, 1)).alias("empty_postings"),
        F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n") * 6 + 24)), F.lit(0)).alias("memory_bytes"))
    return totals.crossJoin(postings.agg(F.countDistinct("file_id").alias("total_files")))  # two single rows


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, file_id, change) over all paths: added files get ids after the greatest ever
    issued, removed ones keep theirs as tombstones.  ``old`` has path, mtime, size, file_id
    and removed; ``new`` path, mtime, size.  A tombstone that comes back is added anew."""
    last = old.agg(F.coalesce(F.max("file_id"), F.lit(-1)).alias("last"))
    live = old.where("not removed").select("path", "file_id", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.lit(True).alias("was"))
    both = live.join(new.select("path", "mtime", "size", F.lit(True).alias("now")), "path", "full")
    same = F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("size").eqNullSafe(F.col("old_size"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(~same, "updated").otherwise("same")
    marked = both.withColumn("change", change)
    added = number_rows(marked.where("change = 'added'").select("path"), ["path"]).crossJoin(F.broadcast(last))  # one row
    known = marked.where("change <> 'added'").select("path", "file_id", "change")
    return known.unionByName(added.select("path", (F.col("last") + F.col("n")).alias("file_id"), F.lit("added").alias("change")))


def upsert_paths(files: DataFrame, seen: DataFrame) -> DataFrame:
    """(path, mtime, size, file_id, changed) of single files ``seen`` (path, mtime, size): known live paths
    keep their ids and are changed if time or size differ; others get ids after the greatest ever
    issued.  ``files`` is the files table (path, mtime, size, file_id, removed)."""
    live = files.where("not removed").select("path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"), F.col("file_id").alias("old_id"))
    both = seen.select("path", "mtime", "size").join(live, "path", "left")
    last = files.agg(F.coalesce(F.max("file_id"), F.lit(-1)).alias("last"))
    new = number_rows(both.where("old_id is null").select("path", "mtime", "size"), ["path"]).crossJoin(F.broadcast(last))  # one row
    same = F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("size").eqNullSafe(F.col("old_size"))
    known = both.where("old_id is not null").select("path", "mtime", "size", F.col("old_id").cast("long").alias("file_id"), (~same).alias("changed"))
    return known.unionByName(new.select("path", "mtime", "size", (F.col("last") + F.col("n")).cast("long").alias("file_id"), F.lit(True).alias("changed")))


def number_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` with n = 1, 2, ... in the given order (of columns without equal rows).

    The rows are sorted once by ranges, as many as the session's partitions, and written with
    their places; a row's number is its place in its range after the sizes of the ranges
    before, so no task sees more than a range and nothing is computed twice.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialise(ranged.withColumn("at_", F.monotonically_increasing_id()), "numbered")
    part, place = F.shiftright("at_", 33), F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = rows.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("held_"))
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    starts = sizes.select("part_", F.coalesce(F.sum("held_").over(before), F.lit(0)).alias("start_"))
    return rows.withColumn("part_", part).join(F.broadcast(starts), "part_").withColumn("n", F.col("start_") + place + 1).drop("at_", "part_", "start_")


def apply_refresh(postings: DataFrame, diff: DataFrame, docs: DataFrame) -> DataFrame:
    """Postings after removed and updated files are deleted and added and updated ones indexed.
    ``docs``: file_id and text of the new snapshot."""
    gone = diff.where("change in ('removed', 'updated')").select("file_id")
    fresh = docs.join(diff.where("change in ('added', 'updated')").select("file_id"), "file_id", "left_semi")
    return postings.join(gone, "file_id", "left_anti").select("word", "file_id", "cnt").unionByName(build_postings(fresh))


def compact(vocabulary: DataFrame, postings: DataFrame, percent: float = 5.0) -> DataFrame:
    """(old_id, word, new_id): dense ids for words with postings, in the old order, if at least
    ``percent`` of all words are holes; otherwise the ids as they are."""
    held = postings.select("word").distinct().withColumn("held", F.lit(True))
    marked = materialise(vocabulary.select(F.col("word_id").alias("old_id"), "word").join(held, "word", "left"), "vocabulary")
    words, live = marked.agg(F.count(F.lit(1)), F.count("held")).first()  # two numbers
    if words > live and 100 * (words - live) >= percent * words:
        return number_rows(marked.where("held").select("old_id", "word"), ["old_id"]).select("old_id", "word", (F.col("n") - 1).alias("new_id"))
    return marked.select("old_id", "word", F.col("old_id").alias("new_id"))


def missing_postings(stored: DataFrame, docs: DataFrame) -> DataFrame:
    """Words of files that the stored index lacks, with a count of 1 (repair of holes)."""
    return build_postings(docs).join(stored.select("word", "file_id"), ["word", "file_id"], "left_anti").select("word", "file_id", F.lit(1).cast("long").alias("cnt"))


def save(postings: DataFrame, files: DataFrame, folder: str, version: int) -> str:
    """Write one version of the index, clustered by word so that a lookup reads few row groups.
    Its mark comes last and at once: a version without one is not there for readers."""
    at = f"{folder}/v{version:08d}"
    postings.select("word", "file_id", "cnt").repartitionByRange("word").sortWithinPartitions("word", "file_id").write.mode("overwrite").parquet(f"{at}/postings")
    files.write.mode("overwrite").parquet(f"{at}/files")
    mark(postings.sparkSession, f"{at}/_CURRENT")
    return at


def load(spark, at: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{at}/postings"), spark.read.parquet(f"{at}/files")


def current_version(spark, folder: str) -> int | None:
    """The newest version that is complete."""
    done = [int(v[1:]) for v in children(spark, folder) if v[:1] == "v" and v[1:].isdigit() and exists(spark, f"{folder}/{v}/_CURRENT")]
    return max(done, default=None)


def load_current(spark, folder: str) -> tuple[DataFrame, DataFrame] | None:
    version = current_version(spark, folder)
    return None if version is None else load(spark, f"{folder}/v{version:08d}")


def drop_versions(spark, folder: str, keep: int = 2) -> None:
    """Delete all but the newest complete versions (readers of the last one may still run)."""
    for v in sorted(v for v in children(spark, folder) if v[:1] == "v" and exists(spark, f"{folder}/{v}/_CURRENT"))[:-keep]:
        delete(spark, f"{folder}/{v}")


FILES = "path string, mtime timestamp, size long, file_id long, removed boolean"


def files_after(old: DataFrame, new: DataFrame, diff: DataFrame) -> DataFrame:
    """The files table (FILES) after a change ``diff`` between ``old`` and the snapshot ``new``: removed
    files stay as tombstones, so that their ids are not given again."""
    known = diff.where("change <> 'removed'").select("path", "file_id").join(new.select("path", "mtime", "size"), "path").withColumn("removed", F.lit(False))
    gone = old.join(known.select("file_id"), "file_id", "left_anti").withColumn("removed", F.lit(True))
    return known.select("path", "mtime", "size", "file_id", "removed").unionByName(gone.select("path", "mtime", "size", "file_id", "removed"))
