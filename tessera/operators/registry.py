"""The registry of records: upserts, summaries, ignore lists and seen numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Departments whose records are not registered.
IGNORED = ("ИСХ", "ТРАНЗИТ")


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """``target`` with the rows of ``source`` inserted, or replacing those of equal key."""
    return target.join(source.select(key), key, "left_anti").select(*target.columns).unionByName(source.select(*target.columns))


def ignore_filter(rows: DataFrame, column: str, ignored: list[str] | DataFrame = list(IGNORED)) -> DataFrame:
    """Rows whose department is not on the list (compared in upper case; null is on no list)."""
    if isinstance(ignored, DataFrame):
        names = ignored.select(T.upper(F.col(ignored.columns[0])).alias("name_")).distinct()
        return rows.join(names, T.upper(F.col(column)) == F.col("name_"), "left_anti")
    return rows.where(~F.coalesce(T.upper(F.col(column)).isin(ignored), F.lit(False)))


def number_set(table: DataFrame, column: str) -> DataFrame:
    """(num): distinct integers that values of a column begin with."""
    return table.select(T.leading_int(F.col(column).cast("string")).alias("num")).where("num is not null").distinct()


def seen_in(rows: DataFrame, key: str, *sets: DataFrame) -> DataFrame:
    """Rows whose key is in any of the number sets."""
    union = sets[0]
    for s in sets[1:]:
        union = union.unionByName(s)
    return rows.join(union.distinct(), F.col(key) == F.col("num"), "left_semi")


def update_summaries(archive: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """``archive`` with column kr set where ``fresh`` (key, kr) has another, non-empty text."""
    new = fresh.select(F.col(key).alias("k_"), F.col("kr").alias("kr_"))
    joined = archive.join(new, F.col(key) == F.col("k_"), "left")
    kr = F.when((F.coalesce("kr_", F.lit("")) != "") & ~F.col("kr_").eqNullSafe(F.col("kr")), F.col("kr_")).otherwise(F.col("kr"))
    return joined.select(*(kr.alias("kr") if c == "kr" else F.col(c) for c in archive.columns))


def normalise_lists(rows: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    """Rows with ``lists`` as a positive number, or else the archive's; rows with neither go."""
    found = archive.select(F.col(key).alias("k_"), F.col("lists").alias("l_")).dropDuplicates(["k_"])
    own = T.leading_int(F.trim("lists"))
    other = T.leading_int(F.trim("l_"))
    value = F.when(own > 0, own).when(other > 0, other)
    joined = rows.join(found, F.col(key) == F.col("k_"), "left")
    return joined.withColumn("lists", value.cast("string")).where("lists is not null").drop("k_", "l_")


def register_events(events: DataFrame, archive: DataFrame, registry: DataFrame, key: str = "num") -> tuple[DataFrame, DataFrame]:
    """The order of work on new records (num, podrazd, lists, kr, ..): the journal's summaries are
    updated first, then ignored departments go, then records without lists, then the upsert."""
    updated = update_summaries(archive, events.select(key, "kr"), key)
    due = normalise_lists(ignore_filter(events, "podrazd"), archive, key)
    return updated, upsert(registry, due, key)
