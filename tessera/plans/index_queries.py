"""Queries on the inverted index and search, over the documents table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import engine
from tessera.config import EngineConfig
from tessera.functions import text as T
from tessera.operators import index, search
from tessera.plans.registry import query, table
from tessera.tables import shared_folder

PUNCTUATION_SQL = T.PUNCTUATION.replace("'", "''")


def words_sql(text: str) -> str:
    return f"list_filter(list_transform(regexp_split_to_array(translate({text}, '{T.LOWER}', '{T.UPPER}'), '{T.DELIMITERS}'), lambda w: trim(w, '{PUNCTUATION_SQL}')), lambda w: w <> '')"


def postings_sql(source: str = "SELECT doc_id AS file_id, text FROM documents") -> str:
    return f"docs AS ({source}), post AS (SELECT word, file_id, count(*) AS cnt FROM (SELECT file_id, unnest({words_sql('text')}) AS word FROM docs) GROUP BY word, file_id)"


_SAVED: dict[tuple[str, str], str] = {}


def saved_index(spark: SparkSession, sf: str) -> str:
    """The folder of an index of the documents, built and saved once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SAVED:
        folder = f"{shared_folder(spark).rstrip('/')}/tessera-index-{uuid.uuid4().hex}"
        files = table(spark, sf, "documents").select(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("doc_id").alias("file_id"))
        index.save(postings_of(spark, sf), files, folder, 1)
        _SAVED[key] = folder
    return _SAVED[key]


def docs_of(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("file_id"), "text")


def postings_of(spark: SparkSession, sf: str) -> DataFrame:
    return index.build_postings(docs_of(spark, sf))


REQUESTS = [(1, "the and of"), (2, "Der, die; und!"), (3, "que de la missingword"), (4, "password"), (5, ""), (6, "the THE The"), (7, "über ciónes été")]
ALL_WORDS = [(1, "the and of"), (2, "Der, die; und!"), (3, "que de la missingword"), (4, "que de la")]


def _requests(spark: SparkSession, rows=REQUESTS) -> DataFrame:
    return spark.createDataFrame(rows, "request_id int, request string")


def _search_sql(rows, exact: bool, limit: int) -> str:
    values = ", ".join("({}, '{}')".format(i, r.replace("'", "''")) for i, r in rows)
    return f"""
        WITH {postings_sql()},
        asked AS (SELECT i, list_distinct({words_sql("r")}) AS ws FROM (VALUES {values}) v(i, r)),
        w AS (SELECT i, len(ws) AS n, unnest(ws) AS word FROM asked),
        hits AS (SELECT i, n, file_id, sum(cnt) AS hits, count(*) AS m FROM w JOIN post USING (word) GROUP BY ALL {"HAVING count(*) = n" if exact else ""}),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY hits DESC, file_id) AS rank, max(hits) OVER (PARTITION BY i) AS best FROM hits)
        SELECT CAST(i AS INTEGER) AS request_id, file_id, CAST(hits AS BIGINT) AS hits, CAST(CAST(hits AS FLOAT) / CAST(best AS FLOAT) AS FLOAT) AS relevance, CAST(rank AS INTEGER) AS rank
        FROM ranked WHERE rank <= {limit}"""


@query(f"SELECT doc_id AS file_id, CAST(len({words_sql('text')}) AS BIGINT) AS n_words, CAST(len(list_distinct({words_sql('text')})) AS BIGINT) AS n_distinct FROM documents")
def tokenize_counts(spark, sf):
    w = T.words(F.col("text"))
    return docs_of(spark, sf).select("file_id", F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))


@query("SELECT doc_id AS file_id, CAST(len(regexp_extract_all(text, '[0-9A-Za-z\\x{80}-\\x{10FFFF}]+')) AS BIGINT) AS n_words FROM documents")
def legacy_tokenizer(spark, sf):
    return docs_of(spark, sf).select("file_id", F.size(T.legacy_words(F.col("text"))).cast("long").alias("n_words"))


@query(f"WITH {postings_sql()} SELECT word, file_id, cnt FROM post")
def build_postings(spark, sf):
    return postings_of(spark, sf)


@query(f"WITH {postings_sql()} SELECT word, file_id, cnt FROM post WHERE word IN ('THE', 'UND', 'PASSWORD')")
def word_lookup(spark, sf):
    return index.word_lookup(postings_of(spark, sf), ["the", "Und", "PASSWORD"])


@query(f"WITH {postings_sql()} SELECT file_id, CAST(len(list(word)) AS BIGINT) AS n, md5(array_to_string(list_sort(list(word)), ' ')) AS digest FROM post GROUP BY file_id")
def file_words(spark, sf):
    return index.file_words(postings_of(spark, sf)).select("file_id", F.size("words").cast("long").alias("n"), F.md5(F.array_join("words", " ")).alias("digest"))


@query(f"""WITH {postings_sql()}, lists AS (SELECT word, count(*) AS n FROM post GROUP BY word)
    SELECT count(*) AS unique_words, CAST(sum(n) AS BIGINT) AS total_postings, CAST(0 AS BIGINT) AS empty_postings, CAST(sum(6 * n + 24) AS BIGINT) AS memory_bytes,
        (SELECT count(DISTINCT file_id) FROM post) AS total_files FROM lists""")
def index_stats(spark, sf):
    return index.stats(postings_of(spark, sf))


@query(f"""WITH {postings_sql()}, lists AS (SELECT word, count(*) FILTER (WHERE file_id % 3 <> 0) AS n FROM post GROUP BY word)
    SELECT count(*) AS unique_words, CAST(sum(n) AS BIGINT) AS total_postings, count(*) FILTER (WHERE n = 0) AS empty_postings, CAST(sum(CASE WHEN n > 0 THEN 6 * n + 24 ELSE 0 END) AS BIGINT) AS memory_bytes,
        (SELECT count(DISTINCT file_id) FROM post WHERE file_id % 3 <> 0) AS total_files FROM lists""")
def index_stats_with_holes(spark, sf):
    post = index.load_current(spark, saved_index(spark, sf))[0]
    return index.stats(post.where("file_id % 3 <> 0"), post)


@query(_search_sql(REQUESTS[:1], False, 30))
def search_or_topk(spark, sf):
    return search.search(index.load_current(spark, saved_index(spark, sf))[0], _requests(spark, REQUESTS[:1]))


@query(_search_sql(ALL_WORDS, True, 5))
def search_exact_topk(spark, sf):
    return search.search(index.load_current(spark, saved_index(spark, sf))[0], _requests(spark, ALL_WORDS), EngineConfig(exact=True, limit=5))


@query(_search_sql(REQUESTS, False, 30))
def search_batch(spark, sf):
    return search.search(index.load_current(spark, saved_index(spark, sf))[0], _requests(spark))


@query(_search_sql(REQUESTS, False, 30))
def search_unindexed(spark, sf):
    return search.search_texts(docs_of(spark, sf), _requests(spark))


@query(_search_sql(REQUESTS, False, 1 << 40))
def search_unlimited(spark, sf):
    return search.search(index.load_current(spark, saved_index(spark, sf))[0], _requests(spark), EngineConfig(limit=0))


_FOUND = f"(SELECT *, 'docs/' || file_id || '.txt' AS path FROM ({_search_sql(REQUESTS, False, 30)}))"


@query(f"SELECT * FROM {_FOUND}")
def search_paths(spark, sf):
    return engine.answer(spark, saved_index(spark, sf), _requests(spark))


@query(f"SELECT request_id, rank, path || ';' || printf('%.6f', CAST(relevance AS DOUBLE)) AS line FROM {_FOUND}")
def search_text_lines(spark, sf):
    return search.text_lines(search_paths(spark, sf))


_ASKED_SQL = ", ".join(f"({i})" for i, _ in REQUESTS)


@query(f"""WITH lists AS (SELECT request_id, string_agg('["' || path || '",' || CAST(CAST(relevance AS DOUBLE) AS VARCHAR) || ']', ',' ORDER BY rank) AS l FROM {_FOUND} GROUP BY request_id)
    SELECT 'request' || lpad(CAST(i AS VARCHAR), 3, '0') AS label, CASE WHEN l IS NULL THEN '{{"result":false}}' ELSE '{{"result":true,"relevance":[' || l || ']}}' END AS body
    FROM (VALUES {_ASKED_SQL}) v(i) LEFT JOIN lists ON i = request_id""")
def search_labelled_json(spark, sf):
    return search.answers(_requests(spark), search_paths(spark, sf))


_JOURNAL = """archive AS (SELECT CAST(doc_id AS VARCHAR) AS num, CAST(quality AS VARCHAR) AS quality FROM labels)"""


@query(f"""WITH hits AS (SELECT rank, path, relevance FROM {_FOUND} WHERE request_id = 1), {_JOURNAL}
    SELECT rank, '{{"path":"' || path || '","relevance":' || CAST(relevance AS VARCHAR) || ',"type":1,"num":"' || coalesce(a.num, '') || '","quality":"' || coalesce(a.quality, '') || '"}}' AS json
    FROM hits LEFT JOIN archive a ON regexp_extract(path, '([0-9]+)[.]txt$', 1) = a.num""")
def search_journal_json(spark, sf):
    archive = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("num"), F.col("quality").cast("string").alias("quality"), F.lit(0).alias("shard_prio"))
    return engine.answer_journal(spark, saved_index(spark, sf), REQUESTS[0][1], archive, "num", ["quality"])


@query("""SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS request_id, text AS request FROM conversations WHERE conv_id % 5 <> 0""")
def requests_from_json(spark, sf):
    lists = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    body = F.to_json(F.struct(F.col("l.text").alias("Requests")))
    return search.requests_from_json(lists.select("conv_id", F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("{"), body)).otherwise(body).alias("body")), "body", ["conv_id"])


# ---------------------------------------------------------------- changes

_OLD = "SELECT 'd' || doc_id AS path, n_chars AS mtime, n_chars AS size, doc_id AS file_id, doc_id % 13 = 0 AS removed FROM documents WHERE doc_id % 10 <> 0"
_NEW = "SELECT 'd' || doc_id AS path, n_chars + CAST(doc_id % 5 = 0 AS BIGINT) AS mtime, n_chars + CAST(doc_id % 11 = 0 AS BIGINT) AS size FROM documents WHERE doc_id % 7 <> 0"
_DIFF = f"""old AS ({_OLD}), new AS ({_NEW}), live AS (SELECT * FROM old WHERE NOT removed),
    marked AS (SELECT coalesce(l.path, n.path) AS path, l.file_id, CASE WHEN l.path IS NULL THEN 'added' WHEN n.path IS NULL THEN 'removed'
        WHEN l.mtime <> n.mtime OR l.size <> n.size THEN 'updated' ELSE 'same' END AS change FROM live l FULL JOIN new n ON l.path = n.path),
    diff AS (SELECT path, file_id, change FROM marked WHERE change <> 'added' UNION ALL
        SELECT path, (SELECT max(file_id) FROM old) + row_number() OVER (ORDER BY path), change FROM marked WHERE change = 'added')"""


def _snapshots(spark, sf):
    docs = table(spark, sf, "documents")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    flag = lambda k: (F.col("doc_id") % k == 0)
    old = docs.where(~flag(10)).select(path.alias("path"), F.col("n_chars").alias("mtime"), F.col("n_chars").alias("size"), F.col("doc_id").alias("file_id"), flag(13).alias("removed"))
    new = docs.where(~flag(7)).select(path.alias("path"), (F.col("n_chars") + flag(5).cast("long")).alias("mtime"), (F.col("n_chars") + flag(11).cast("long")).alias("size"))
    return docs.withColumn("path", path), old, new


@query(f"WITH {_DIFF} SELECT path, CAST(file_id AS BIGINT) AS file_id, change FROM diff")
def snapshot_diff(spark, sf):
    _, old, new = _snapshots(spark, sf)
    return index.snapshot_diff(old, new)


@query(f"""WITH old AS ({_OLD}), new AS ({_NEW}), live AS (SELECT * FROM old WHERE NOT removed)
    SELECT n.path, n.mtime, n.size, CAST(coalesce(l.file_id, (SELECT max(file_id) FROM old) + row_number() OVER (PARTITION BY l.file_id IS NULL ORDER BY n.path)) AS BIGINT) AS file_id,
        l.file_id IS NULL OR n.mtime <> l.mtime OR n.size <> l.size AS changed FROM new n LEFT JOIN live l ON n.path = l.path""")
def path_upsert(spark, sf):
    _, old, new = _snapshots(spark, sf)
    return index.upsert_paths(old, new)


@query(f"""WITH {_DIFF}, {postings_sql("SELECT CAST(d.file_id AS BIGINT) AS file_id, t.text || CASE WHEN change = 'updated' THEN ' rewritten' ELSE '' END AS text FROM diff d JOIN documents t ON d.path = 'd' || t.doc_id WHERE change <> 'removed'")}
    SELECT word, file_id, cnt FROM post""")
def refresh_equals_rebuild(spark, sf):
    docs, old, new = _snapshots(spark, sf)
    diff = index.snapshot_diff(old, new)
    before = index.build_postings(docs.join(old.where("not removed").select("path", "file_id"), "path"))
    tail = F.when(F.col("change") == "updated", " rewritten").otherwise("")
    now = docs.select("path", "text").join(diff, "path").select("file_id", F.concat("text", tail).alias("text"))
    return index.apply_refresh(before, diff, now)


@query(f"""WITH {postings_sql()}, vocab AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS word_id FROM (SELECT DISTINCT word FROM post)),
    live AS (SELECT * FROM vocab WHERE word IN (SELECT word FROM post WHERE file_id % 3 <> 0))
    SELECT CAST(word_id AS BIGINT) AS old_id, word, CAST(row_number() OVER (ORDER BY word_id) - 1 AS BIGINT) AS new_id FROM live""")
def compact_ids(spark, sf):
    post = index.load_current(spark, saved_index(spark, sf))[0]
    vocabulary = index.number_rows(post.select("word").distinct(), ["word"]).select("word", (F.col("n") - 1).alias("word_id"))
    return index.compact(vocabulary, post.where("file_id % 3 <> 0"))


@query(f"WITH {postings_sql()} SELECT word, file_id, CAST(1 AS BIGINT) AS cnt FROM post WHERE file_id % 50 = 0")
def hole_repair(spark, sf):
    return index.missing_postings(postings_of(spark, sf).where("file_id % 50 <> 0"), docs_of(spark, sf))
