"""Lookups in the sharded journal: shards are one table with ``shard_prio`` (0 comes first)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

INCOMING, OUTGOING = 0, 1
#: Which journal columns a result field comes from, by record type.
FIELDS = {
    INCOMING: {"isp": "familia", "pril_name": "prilname1", "from_to": "ffrom", "blank": "copyes2"},
    OUTGOING: {"isp": "copyes", "pril_name": "ffrom5", "from_to": "ffrom1", "blank": "blank"},
}


def union_shards(shards: list[DataFrame]) -> DataFrame:
    """Shards in order of priority as one table.  Columns keep their types, so that conditions and the
    choice of columns reach the scans; a journal gives texts only in its result (``as_texts``)."""
    out = None
    for i, s in enumerate(shards):
        one = s.withColumn("shard_prio", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def as_texts(rows: DataFrame) -> DataFrame:
    """All columns but shard_prio as texts, nulls as empty ones."""
    return rows.select(*(F.col(c) if c == "shard_prio" else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in rows.columns))


def journal_query(archive: DataFrame, condition: Column | str, order_by: list[str | Column], limit: int | None = None) -> DataFrame:
    """Rows that meet a condition, by shard and then ``order_by``; ``limit`` holds over all shards."""
    out = archive.where(condition).orderBy("shard_prio", *order_by)
    return out if limit is None else out.limit(limit)


#: The fields of a journal result, in order.
RESULT = ("num", "ddata", "from_to", "tel_num", "podpno", "datapodp", "isp", "pril_name", "kolpril", "blank", "gdesht", "podrazd", "path", "type", "rel")


def result_json(rows: DataFrame) -> DataFrame:
    """(rank, json): journal results (``rank`` and fields) as one JSON object a row; a sink joins them
    with commas between brackets."""
    fields = [c for c in rows.columns if c != "rank"]
    return rows.select("rank", F.to_json(F.struct(*fields)).alias("json"))


def write_json(rows: DataFrame, path: str) -> None:
    """Sink: one array of the objects of ``result_json``, by rank, written row by row."""
    with open(path, "w", encoding="utf-8") as out:
        out.write("[")
        for i, r in enumerate(rows.orderBy("rank").toLocalIterator()):
            out.write(("," if i else "") + r["json"])
        out.write("]")


def result_row(archive: DataFrame, kind: int, *more: Column) -> DataFrame:
    """The columns of a journal result for one record type (and ``more``); plain journal rows are fully relevant."""
    f = FIELDS[kind]
    return archive.select(
        *more,
        F.col("index").alias("num"), "ddata", F.col(f["from_to"]).alias("from_to"), (F.col("telno") if kind == INCOMING else F.col("index")).alias("tel_num"), "podpno", "datapodp",
        F.col(f["isp"]).alias("isp"), F.col(f["pril_name"]).alias("pril_name"), "kolpril", F.col(f["blank"]).alias("blank"), "gdesht", "podrazd",
        T.record_path(F.col("directto"), F.col("filename"), False).alias("path"), F.lit(kind).alias("type"), F.lit(1.0).cast("float").alias("rel"))


def first_shard_lookup(archive: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """For each key the first row of the first shard that has it."""
    n = F.row_number().over(Window.partitionBy(key).orderBy("shard_prio", *order_by))
    return archive.withColumn("n_", n).where("n_ = 1").drop("n_")


def last_by_index(archive: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """For each key its last row, in a stated order."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*(F.desc(c) for c in ["shard_prio", *order_by])))
    return archive.withColumn("n_", n).where("n_ = 1").drop("n_")


def search_journal(hits: DataFrame, archive: DataFrame, key: str, order_by: list[str]) -> DataFrame:
    """Ranked hits (rank, path, relevance) joined with the journal.

    Only files named by a number count, once for each number and type, at their best rank; a
    hit without a journal row stays, with an empty number.
    """
    name = T.file_name(F.col("path"))
    named = hits.select("rank", "path", "relevance", T.numeric_name(name).alias("num_"), T.record_type(name).alias("type")).where("num_ <> ''")
    first = named.withColumn("n_", F.row_number().over(Window.partitionBy("num_", "type").orderBy("rank"))).where("n_ = 1").drop("n_")
    rows = first_shard_lookup(archive, key, order_by).drop("shard_prio")
    out = first.join(rows, F.col("num_") == F.col(key), "left")
    return out.drop("num_").fillna("", [c for c, t in rows.dtypes if t == "string"])


def route(way: DataFrame, pending: DataFrame, now: Column) -> DataFrame:
    """Routing rows (number, type, kuda, ddate, ttime, ind, str, pos) and, for each number and
    type with an unprinted row in ``pending`` (number, type, print, gdesht, seq), one row more."""
    first = pending.where("print = 0").groupBy("number", "type").agg(F.min(F.struct("seq", "gdesht")).alias("p"))
    extra = first.select(
        "number", "type", F.concat(F.lit("L-k:"), "p.gdesht").alias("kuda"), F.date_format(now, "dd.MM.yyyy").alias("ddate"), F.date_format(now, "HH:mm:ss").alias("ttime"),
        F.lit("0").alias("ind"), F.lit("-").alias("str"), F.lit("-").alias("pos"))
    return way.select(*extra.columns).unionByName(extra)


def confirmations(archive: DataFrame, ids: list) -> DataFrame:
    """Confirmation columns by id, over all shards."""
    return archive.where(F.col("index").isin(ids)).select("shard_prio", "index", "pdtv", "allpdtv1")


def attachments(archive: DataFrame, listing: DataFrame, kind: int, key: str, names: str, order_by: list[str]) -> DataFrame:
    """(key, name, exists, size): attachments of the first shard's row; an incoming record lists
    its names with semicolons, an outgoing one has one archive named by its number."""
    rows = first_shard_lookup(archive, key, order_by)
    each = F.split(names, ";") if kind == INCOMING else F.array(F.concat(F.col(key).cast("string"), F.lit(".zip")))
    listed = rows.select(key, F.explode(F.filter(each, lambda x: x != "")).alias("name"))
    return listed.join(listing.select("name", "size"), "name", "left").select(key, "name", F.col("size").isNotNull().alias("exists"), F.coalesce("size", F.lit(0)).alias("size"))


def single_attachment(record: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """One row: an attachment's bytes; ``[]`` without a record or attachment names, empty without the file."""
    has = record.where("prilname <> ''").agg((F.count(F.lit(1)) > 0).alias("has"))
    content = files.where(F.col("name") == name).agg(F.first("content").alias("content"))
    return has.crossJoin(content).select(F.when(F.col("has"), F.coalesce("content", F.lit("").cast("binary"))).otherwise(F.lit("[]").cast("binary")).alias("content"))  # two single rows
