"""Queries on journals, registries, events and housekeeping, with star-schema tables standing in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import events, journal, registry, upkeep
from tessera.plans.registry import query, table
from tessera.sources import files

# ---------------------------------------------------------------- scalar functions

_TRIM = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


_QUOTES = "replace(replace(replace({}, chr(39) || chr(39), chr(34)), chr(39), chr(34)), chr(34) || chr(34), chr(34))"


@query(f"SELECT doc_id, md5(upper(text[1:1]) || lower(text[2:])) AS cap, {_QUOTES.format('text')}[1:100] AS short, {_QUOTES.format('chr(39) || text')}[1:100] AS quoted FROM documents")
def capitalise_shorten(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.capitalise(F.col("text"))).alias("cap"), T.shorten(F.col("text")).alias("short"), T.shorten(F.concat(F.lit("'"), "text")).alias("quoted"))


@query(f"SELECT doc_id, md5(translate(text, '{T.UPPER}', '{T.LOWER}')) AS low FROM documents")
def lowercase_table(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.lower(F.col("text"))).alias("low"))


def _cleanup_sql(c):
    out = rf"regexp_replace(regexp_replace({c}, '[\n\r]', ' ', 'g'), ' +', ' ', 'g')"
    for old, new in (("''", '"'), ("'", '"'), ('""', '"'), ("\u00a0", ""), (",", ", ")):
        out = "replace({}, '{}', '{}')".format(out, old.replace("'", "''"), new)
    return out


@query(f"SELECT doc_id, md5({_cleanup_sql('text')}) AS digest, md5({_cleanup_sql(repr('it') + ' || chr(39) || chr(39) || text')}) AS quoted FROM documents")
def cleanup_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(T.cleanup(F.col("text"))).alias("digest"), F.md5(T.cleanup(F.concat(F.lit("it''"), "text"))).alias("quoted"))


_MARKED = "'a' || chr(10) || 'b' || chr(10) || 'c' || chr(10) || '= ' || string_split(text, chr(10))[1][1:40] || chr(10) || text[50:109] || ' =' || chr(10) || text"
_BLOCK = rf"""WITH l AS (SELECT doc_id, strlen(text) AS size, list_filter(list_transform(string_split({_MARKED}, chr(10))[4:], lambda x: regexp_replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), ' +', ' ', 'g')), lambda x: NOT contains(x, 'ЛИЧНО')) AS lines FROM documents),
    s AS (SELECT *, list_position(list_transform(lines, lambda x: starts_with(x, '=') AND strlen(x) >= 5), true) AS a,
        list_transform(lines, lambda x: len(list_filter(range(1, least(length(x), 91) + 1), lambda k: x[k:k] = '=' AND strlen(x[1:k - 1]) BETWEEN 4 AND 90)) > 0) AS ends FROM l),
    e AS (SELECT *, list_position(ends[a:], true) AS n FROM s),
    b AS (SELECT doc_id, size, CASE WHEN a > 0 AND n > 0 THEN regexp_extract(array_to_string(lines[a:a + n - 1], ' '), '(?s)^.*=') ELSE '' END AS block FROM e)"""


def _cleaned_sql(c):
    return rf"regexp_replace({_cleanup_sql(c)}, '^\s+|\s+$', '', 'g')"


@query(f"""{_BLOCK}, c AS (SELECT *, {_cleaned_sql("replace(block, '=', '')")} AS clean FROM b)
    SELECT doc_id, block, CASE WHEN size <= 5242880 THEN upper(clean[1:1]) || lower(clean[2:]) ELSE '' END AS summary FROM c""")
def marked_blocks(spark, sf):
    head, lines = F.lit("a\nb\nc\n"), F.split("text", "\n")
    marked = F.concat(head, F.lit("= "), F.substring(F.get(lines, F.lit(0)), 1, 40), F.lit("\n"), F.substring("text", 50, 60), F.lit(" =\n"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", T.marked_block(marked).alias("block"), T.summary(marked, F.octet_length("text")).alias("summary"))


_NAMES = """(SELECT page_id, regexp_extract(url, '[^/]*$') || CASE CAST(page_id % 6 AS INTEGER) WHEN 0 THEN '' WHEN 1 THEN '.TXT' WHEN 2 THEN '.atxt' WHEN 3 THEN '.' WHEN 4 THEN '.tar.gz' ELSE 'txt' END AS name,
    CASE WHEN page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) ELSE 'x' || page_id END || CASE WHEN page_id % 2 = 0 THEN '.zip' ELSE '' END AS num FROM pages)"""


def _names(spark, sf):
    k = F.col("page_id") % 6
    tail = F.when(k == 0, "").when(k == 1, ".TXT").when(k == 2, ".atxt").when(k == 3, ".").when(k == 4, ".tar.gz").otherwise("txt")
    num = F.concat(F.when(F.col("page_id") % 3 == 0, F.col("page_id").cast("string")).otherwise(F.concat(F.lit("x"), F.col("page_id").cast("string"))), F.when(F.col("page_id") % 2 == 0, ".zip").otherwise(""))
    return table(spark, sf, "pages").select("page_id", F.concat(F.regexp_extract("url", "[^/]*$", 0), tail).alias("name"), num.alias("num"))


_EXT = "CASE WHEN contains(name, '.') THEN regexp_extract(name, '[^.]*$') ELSE '' END"


@query(f"""SELECT page_id, lower(name) LIKE '%txt' OR NOT contains(name, '.') AS scan, (contains(name, '.') AND lower({_EXT}) LIKE '%txt') OR NOT contains(name, '.') OR name LIKE '%.' AS event,
    lower({_EXT}) IN ('txt', 'gz') AS registry FROM {_NAMES}""")
def extension_rules(spark, sf):
    name = F.col("name")
    return _names(spark, sf).select("page_id", T.has_extension_scan(name, ["txt", ""]).alias("scan"), T.has_extension_event(name, ["txt", ""]).alias("event"), T.has_extension_registry(name, [".txt", "GZ"]).alias("registry"))


@query(rf"""SELECT page_id, regexp_extract(num, '^([0-9]+)(\.[^.]*)?$', 1) AS num, CAST(CASE WHEN contains(num[2:], '.') THEN 1 ELSE 0 END AS INTEGER) AS type FROM {_NAMES}""")
def numeric_names(spark, sf):
    return _names(spark, sf).select("page_id", T.numeric_name(F.col("num")).alias("num"), T.record_type(F.col("num")).alias("type"))


@query("SELECT page_id, url AS path, length(html) AS size FROM pages WHERE length(html) >= 10 AND NOT contains(regexp_replace(url, '[^/]*$', ''), 'a.example') AND NOT contains(regexp_extract(url, '[^/]*$'), '.')")
def scan_rules(spark, sf):
    pages = table(spark, sf, "pages").withColumn("size", F.length("html").cast("long"))
    return pages.where(files.file_rules(F.col("url"), F.col("size"), [""], ["a.example"], 10)).select("page_id", F.col("url").alias("path"), "size")


@query("SELECT page_id, upper(md5(html)) AS digest FROM pages")
def file_digests(spark, sf):
    return table(spark, sf, "pages").select("page_id", files.file_md5(F.col("html").cast("binary")).alias("digest"))


def _letters_sql(encoding):
    return "[" + ", ".join(f"chr({ord(c)})" if c != "\x00" else "''" for c in (bytes([b]).decode(encoding, "replace") for b in range(256))) + "]"


def _decoded_sql(letters):
    """UTF-8 bytes of the texts read in a one-byte encoding, letter by letter."""
    digits = "'0123456789ABCDEF'"
    read = f"array_to_string(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda p: {letters}[(strpos({digits}, p[1:1]) - 1) * 16 + strpos({digits}, p[2:2])]), '')"
    return f"CASE WHEN contains({read}, chr(65533)) THEN '' ELSE {read} END"


@query(f"SELECT doc_id, md5({_decoded_sql('o')}) AS oem, md5({_decoded_sql('w')}) AS windows FROM documents, (SELECT {_letters_sql('cp866')} AS o, {_letters_sql('cp1251')} AS w)")
def decode_files(spark, sf):
    raw = table(spark, sf, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return raw.select("doc_id", F.md5(files.decode_oem("content")).alias("oem"), F.md5(files.decode_windows("content")).alias("windows"))


#: Request texts of all kinds, one an order; the same expression in both dialects.
_TEXT = """CASE CAST(o_orderkey % 10 AS INTEGER) WHEN 0 THEN 'where upper(ffrom) like (' || chr(39) || '%' || o_orderstatus || '%' || chr(39) || ') limit ' || o_custkey
    WHEN 1 THEN 'select * where upper( status ) like(' || chr(39) || '%' || o_orderpriority || '%' || chr(39) || ') LIMIT  ' || o_custkey WHEN 2 THEN 'c:' || chr(92) || o_custkey
    WHEN 3 THEN 'see ' || o_orderkey || '.docx now' WHEN 4 THEN o_orderpriority WHEN 5 THEN 'limit ' || o_orderkey || '0000000' WHEN 6 THEN 'Исх. № ' || o_custkey || '; b'
    WHEN 7 THEN '-' || o_custkey || ' z' WHEN 8 THEN '' ELSE '_name' || o_custkey END"""
_VALUES = f"(SELECT o_orderkey AS id, {_TEXT} AS t FROM orders)"


def _texts(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_TEXT).alias("t"))


_N, _V, _L = r"regexp_extract(t, '(?i)upper\(\s*([A-Za-z0-9_]+)\s*\)', 1)", r"regexp_extract(t, '(?i)like\s*\(\s*''%([^%'']*)%''\s*\)', 1)", r"regexp_extract(t, '(?i)limit\s+([0-9]+)', 1)"
_SHORT = f"(CASE WHEN {_N} <> '' THEN {_N} || ' ' ELSE '' END || CASE WHEN {_V} <> '' THEN {_V} || ' ' ELSE '' END || CASE WHEN {_L} <> '' THEN 'limit ' || {_L} || ' ' ELSE '' END)"
_SUMMARY = f"CASE WHEN lower(t) LIKE 'where%' OR {_SHORT} = '' THEN t ELSE {_SHORT} END"


@query(rf"""SELECT id, {_SUMMARY} AS summary,
    length(t) >= 3 AND regexp_matches(t, '(?i)^[a-z]:[\\/]|\.(txt|docx|log|shp|json|xml|ini|pdf|db)') AS path, TRY_CAST(regexp_extract(t, '(?i)\blimit\s+([0-9]+)', 1) AS INTEGER) AS lim,
    regexp_matches(t, '^[a-zA-Z_][a-zA-Z0-9_]{{2,}}$') AS username, TRY_CAST(regexp_extract(t, '^-?[0-9]+') AS INTEGER) AS num,
    CAST(CASE WHEN contains(t, 'Исх') THEN coalesce(TRY_CAST(regexp_extract(replace(replace(replace(replace(t, ' ', ''), 'Исх.', ''), '№', ''), ';', ''), '^-?[0-9]+') AS INTEGER), 0) ELSE 0 END AS INTEGER) AS outgoing FROM {_VALUES}""")
def text_rules(spark, sf):
    t = F.col("t")
    return _texts(spark, sf).select("id", T.summarize_sql(t).alias("summary"), T.looks_like_path(t).alias("path"), T.limit_of(t).alias("lim"), T.username_ok(t).alias("username"), T.leading_int(t).alias("num"), T.outgoing_number(t).alias("outgoing"))


@query("SELECT page_id, contains(upper(url || CASE WHEN page_id % 3 = 0 THEN '/outBox/x' ELSE '' END), 'OUT') AS outgoing FROM pages")
def outgoing_paths(spark, sf):
    path = F.concat("url", F.when(F.col("page_id") % 3 == 0, "/outBox/x").otherwise(""))
    return table(spark, sf, "pages").select("page_id", T.is_outgoing(path).alias("outgoing"))


# ---------------------------------------------------------------- journal

_SHARDS = """shards AS (SELECT *, CAST(11 - (month(o_orderdate) - 1) AS INTEGER) AS shard_prio FROM orders)"""


def _shards(spark, sf):
    orders = table(spark, sf, "orders")
    cast = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in orders.columns if c not in ("o_orderkey", "o_custkey", "o_totalprice")]
    return orders.select("o_orderkey", "o_custkey", "o_totalprice", *cast, (12 - F.month("o_orderdate")).alias("shard_prio"))


@query(f"WITH {_SHARDS} SELECT o_orderkey, shard_prio FROM shards WHERE o_orderstatus = 'F' ORDER BY shard_prio, o_orderkey LIMIT 40")
def shard_union_limit(spark, sf):
    months = [table(spark, sf, "orders").where(F.month("o_orderdate") == m) for m in range(12, 0, -1)]
    return journal.journal_query(journal.union_shards(months), F.col("o_orderstatus") == "F", ["o_orderkey"], 40).select("o_orderkey", "shard_prio")


_FIELDS = "CAST(o_orderkey AS VARCHAR) AS num, CAST(o_orderdate AS VARCHAR) AS ddata"


@query(f"""SELECT {_FIELDS}, o_orderstatus AS from_to, CAST(o_custkey AS VARCHAR) AS tel_num, 'p' AS podpno, '' AS datapodp, o_orderpriority AS isp, 'f' || o_custkey AS pril_name, '1' AS kolpril, 'c2' AS blank, 'g' AS gdesht, 'd' AS podrazd,
        'dir/' || o_orderkey AS path, CAST(0 AS INTEGER) AS type, CAST(1 AS FLOAT) AS rel FROM orders
    UNION ALL SELECT {_FIELDS}, 'f1', CAST(o_orderkey AS VARCHAR), 'p', '', 'c', 'f5', '1', 'b', 'g', 'd', 'dir/' || o_orderkey, 1, CAST(1 AS FLOAT) FROM orders""")
def journal_results(spark, sf):
    orders = table(spark, sf, "orders")
    fixed = {"podpno": "p", "datapodp": None, "kolpril": 1, "copyes2": "c2", "gdesht": "g", "podrazd": "d", "ffrom1": "f1", "copyes": "c", "ffrom5": "f5", "blank": "b", "directto": "dir/"}
    rows = orders.select(
        F.col("o_orderkey").alias("index"), F.col("o_orderdate").alias("ddata"), F.col("o_orderstatus").alias("ffrom"), F.col("o_custkey").alias("telno"), F.col("o_orderpriority").alias("familia"),
        F.concat(F.lit("f"), "o_custkey").alias("prilname1"), F.col("o_orderkey").alias("filename"), *(F.lit(v).alias(k) for k, v in fixed.items()))
    texts = journal.as_texts(journal.union_shards([rows])).drop("shard_prio")
    return journal.result_row(texts, journal.INCOMING).unionByName(journal.result_row(texts, journal.OUTGOING))


@query(f"WITH {_SHARDS} SELECT o_custkey, o_orderkey, shard_prio FROM shards QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY shard_prio, o_orderkey) = 1")
def first_shard_lookup(spark, sf):
    return journal.first_shard_lookup(_shards(spark, sf), "o_custkey", ["o_orderkey"]).select("o_custkey", "o_orderkey", "shard_prio")


@query(f"WITH {_SHARDS} SELECT o_custkey, o_orderkey FROM shards QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY shard_prio DESC, o_orderkey DESC) = 1")
def last_row_lookup(spark, sf):
    return journal.last_by_index(_shards(spark, sf), "o_custkey", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query(f"WITH {_SHARDS} SELECT shard_prio, o_custkey AS num, o_orderpriority AS pdtv FROM shards WHERE o_custkey IN (1, 2, 3, 5, 8)")
def confirmation_lookup(spark, sf):
    renamed = _shards(spark, sf).select("shard_prio", F.col("o_custkey").alias("index"), F.col("o_orderpriority").alias("pdtv"), F.lit("").alias("allpdtv1"))
    return journal.confirmations(renamed, [1, 2, 3, 5, 8]).select("shard_prio", F.col("index").alias("num"), "pdtv")


@query("""WITH hits AS (SELECT doc_id, CAST(row_number() OVER (ORDER BY n_chars DESC, doc_id) AS INTEGER) AS rank FROM documents),
    named AS (SELECT rank, CAST(doc_id // 2 AS VARCHAR) AS num, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS type FROM hits WHERE doc_id % 7 <> 0),
    best AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY num, type ORDER BY rank) = 1)
    SELECT rank, type, coalesce(CAST(l.doc_id AS VARCHAR), '') AS num, coalesce(CAST(l.quality AS VARCHAR), '') AS quality FROM best LEFT JOIN labels l ON best.num = CAST(l.doc_id AS VARCHAR)""")
def search_journal(spark, sf):
    from tessera.operators.index import number_rows

    ranked = number_rows(table(spark, sf, "documents").select((-F.col("n_chars")).alias("k"), "doc_id"), ["k", "doc_id"]).withColumnRenamed("n", "rank")
    half = F.floor(F.col("doc_id") / 2).cast("string")
    path = F.concat(F.lit("arch/"), F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x"), half)).otherwise(half), F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(""))
    archive = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("num"), F.col("quality").cast("string").alias("quality"), F.lit(0).alias("shard_prio"))
    hits = ranked.select(F.col("rank").cast("int").alias("rank"), path.alias("path"), F.lit(1.0).cast("float").alias("relevance"))
    return journal.search_journal(hits, archive, "num", ["quality"]).select("rank", "type", "num", "quality")


@query("""WITH way AS (SELECT l_orderkey AS number, CAST(l_linenumber % 2 AS INTEGER) AS type, l_returnflag AS kuda, CAST(l_shipdate AS VARCHAR) AS ddate, l_linenumber || ':00' AS ttime, l_linestatus AS ind, 's' AS str, 'p' AS pos FROM lineitem),
    pend AS (SELECT o_orderkey AS number, CAST(o_custkey % 2 AS INTEGER) AS type, o_orderpriority AS gdesht FROM orders WHERE o_orderstatus = 'O')
    SELECT * FROM way UNION ALL SELECT number, type, 'L-k:' || gdesht, '02.03.2024', '04:05:06', '0', '-', '-' FROM pend""")
def route_with_pending(spark, sf):
    line, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    way = line.select(
        F.col("l_orderkey").alias("number"), (F.col("l_linenumber") % 2).cast("int").alias("type"), F.col("l_returnflag").alias("kuda"), F.col("l_shipdate").cast("string").alias("ddate"),
        F.concat("l_linenumber", F.lit(":00")).alias("ttime"), F.col("l_linestatus").alias("ind"), F.lit("s").alias("str"), F.lit("p").alias("pos"))
    tab = orders.select(F.col("o_orderkey").alias("number"), (F.col("o_custkey") % 2).cast("int").alias("type"), F.when(F.col("o_orderstatus") == "O", 0).otherwise(1).alias("print"), F.col("o_orderpriority").alias("gdesht"), F.col("o_orderkey").alias("seq"))
    return journal.route(way, tab, F.to_timestamp(F.lit("2024-03-02 04:05:06")))


@query("""WITH parts AS (SELECT p_partkey, unnest(string_split(replace(p_name, ' ', ';'), ';')) AS name FROM part),
    listing AS (SELECT DISTINCT p_name[1:4] AS name, CAST(4 AS BIGINT) AS size FROM part)
    SELECT p_partkey, p.name, l.size IS NOT NULL AS "exists", coalesce(l.size, 0) AS size FROM parts p LEFT JOIN listing l ON p.name = l.name WHERE p.name <> ''
    UNION ALL SELECT p_partkey, p_partkey || '.zip', false, 0 FROM part""")
def attachments_explode(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.regexp_replace("p_name", " ", ";").alias("names"), F.lit(0).alias("shard_prio"))
    listing = table(spark, sf, "part").select(F.substring("p_name", 1, 4).alias("name"), F.lit(4).cast("long").alias("size")).distinct()
    kinds = [journal.attachments(part, listing, k, "p_partkey", "names", ["names"]) for k in (journal.INCOMING, journal.OUTGOING)]
    return kinds[0].unionByName(kinds[1])


# ---------------------------------------------------------------- registry


@query("""SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0
    UNION ALL SELECT c_custkey, c_name || '!', c_mktsegment FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT -c_custkey, c_name || '!', c_mktsegment FROM customer WHERE c_custkey % 3 = 0""")
def registry_upsert(spark, sf):
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment")
    new = rows.where("c_custkey % 3 = 0").withColumn("c_name", F.concat("c_name", F.lit("!")))
    return registry.upsert(rows, new.unionByName(new.withColumn("c_custkey", -F.col("c_custkey"))), "c_custkey")


@query("SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name NOT IN (SELECT n_name FROM nation WHERE n_regionkey = 1)")
def ignore_filter(spark, sf):
    nation = table(spark, sf, "nation")
    named = table(spark, sf, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return registry.ignore_filter(named, "n_name", nation.where("n_regionkey = 1").select(F.lower("n_name").alias("n"))).select("c_custkey")


@query("""SELECT DISTINCT o_orderkey FROM orders WHERE o_custkey IN (SELECT TRY_CAST(regexp_extract(CAST(c_custkey AS VARCHAR) || 'x', '^-?[0-9]+') AS INTEGER) FROM customer WHERE c_mktsegment = 'BUILDING')
    OR o_custkey IN (SELECT s_suppkey FROM supplier)""")
def number_sets(spark, sf):
    a = registry.number_set(table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").withColumn("k", F.concat(F.col("c_custkey").cast("string"), F.lit("x"))), "k")
    b = registry.number_set(table(spark, sf, "supplier"), "s_suppkey")
    return registry.seen_in(table(spark, sf, "orders"), "o_custkey", a, b).select("o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new ' || c_custkey ELSE c_name END AS kr FROM customer")
def summary_update(spark, sf):
    base = table(spark, sf, "customer").select("c_custkey", F.col("c_name").alias("kr"))
    fresh = base.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("new "), F.col("c_custkey").cast("string"))).otherwise("").alias("kr"))
    return registry.update_summaries(base, fresh, "c_custkey")


@query("""WITH r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN '0' WHEN o_orderkey % 3 = 1 THEN o_orderkey || ' sheets' ELSE 'none' END AS lists FROM orders),
    v AS (SELECT o_orderkey, CASE WHEN TRY_CAST(regexp_extract(lists, '^-?[0-9]+') AS INTEGER) > 0 THEN TRY_CAST(regexp_extract(lists, '^-?[0-9]+') AS INTEGER) WHEN c.c_nationkey > 0 THEN c.c_nationkey END AS n FROM r LEFT JOIN customer c ON o_custkey = c_custkey)
    SELECT o_orderkey, CAST(n AS VARCHAR) AS lists FROM v WHERE n IS NOT NULL""")
def lists_normalised(spark, sf):
    k = F.col("o_orderkey") % 3
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.when(k == 0, "0").when(k == 1, F.concat(F.col("o_orderkey").cast("string"), F.lit(" sheets"))).otherwise("none").alias("lists"))
    archive = table(spark, sf, "customer").select(F.col("c_custkey").alias("num"), F.col("c_nationkey").cast("string").alias("lists"))
    return registry.normalise_lists(rows.withColumnRenamed("o_custkey", "num"), archive, "num").select("o_orderkey", "lists")


# ---------------------------------------------------------------- events

_KIND = "CASE event_type WHEN 'signup' THEN 'Added' WHEN 'error' THEN 'Removed' WHEN 'click' THEN 'Modified' WHEN 'view' THEN 'RenamedOld' ELSE 'RenamedNew' END"
_MERGE = """CASE WHEN b IN ('Removed', 'RenamedOld') THEN b WHEN a = 'Removed' THEN a WHEN a = 'Added' AND b = 'Modified' THEN a WHEN b = 'RenamedNew' THEN 'Added' ELSE b END"""


def _events(spark, sf):
    kind = F.create_map(*(F.lit(x) for pair in (("signup", "Added"), ("error", "Removed"), ("click", "Modified"), ("view", "RenamedOld")) for x in pair))
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("path"), "ts", F.col("event_id").alias("seq"), F.coalesce(kind[F.col("event_type")], F.lit("RenamedNew")).alias("event"))


@query(f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS path, date_trunc('day', ts) AS start, list({_KIND} ORDER BY event_id) AS l FROM events GROUP BY ALL)
    SELECT path, strftime(start, '%Y-%m-%d') AS day, list_reduce(l, lambda a, b: {_MERGE}) AS event, CAST(len(l) AS INTEGER) AS n FROM e""")
def merge_events(spark, sf):
    merged = events.merge_events(_events(spark, sf), "1 day")
    return merged.select("path", F.date_format("start", "yyyy-MM-dd").alias("day"), "event", "n")


@query(f"""WITH e AS (SELECT event_id AS seq, {_KIND} AS event, CASE CAST(user_id % 4 AS INTEGER) WHEN 0 THEN 'in' || user_id || '/a.txt' WHEN 1 THEN 'in' || user_id || '/a.ZAG' WHEN 2 THEN 'inx/b' ELSE 'a/in7/c/d' END AS path FROM events)
    SELECT seq, CASE WHEN event IN ('Removed', 'RenamedOld') THEN 'remove' WHEN lower(path) LIKE '%.zag' THEN 'rewrite' WHEN regexp_matches(path, '(^|/)in[0-9]+/[^/]*$') THEN 'drop' ELSE 'index' END AS route FROM e""")
def route_events(spark, sf):
    u, k = F.col("path"), F.col("path").cast("long") % 4
    path = F.when(k == 0, F.concat(F.lit("in"), u, F.lit("/a.txt"))).when(k == 1, F.concat(F.lit("in"), u, F.lit("/a.ZAG"))).when(k == 2, "inx/b").otherwise("a/in7/c/d")
    return events.route_events(_events(spark, sf).withColumn("path", path)).select("seq", "route")


_NOW = "TIMESTAMP '2024-01-15 00:00:00'"


@query(f"""SELECT event_id AS seq, CASE WHEN user_id % 25 >= 20 THEN 'failed' WHEN ts + INTERVAL 7 SECONDS > {_NOW} THEN 'wait' WHEN user_id % 2 = 0 THEN 'later' ELSE 'run' END AS state,
    strftime(CASE WHEN NOT user_id % 25 >= 20 AND NOT ts + INTERVAL 7 SECONDS > {_NOW} AND user_id % 2 = 0 THEN {_NOW} + INTERVAL 5 SECONDS ELSE ts + INTERVAL 7 SECONDS END, '%Y-%m-%d %H:%M:%S') AS due FROM events""")
def delayed_due(spark, sf):
    user = F.col("path").cast("long")
    rows = _events(spark, sf).select("seq", "ts", (user % 25).alias("tries"), (user % 2 == 1).alias("ready"))
    return events.delayed_due(rows, F.expr(_NOW)).select("seq", "state", F.date_format("due", "yyyy-MM-dd HH:mm:ss").alias("due"))


@query(f"""WITH s AS (SELECT min(event_id) AS stop FROM events WHERE ts + INTERVAL 7 SECONDS > {_NOW})
    SELECT event_id AS seq, CASE WHEN stop IS NULL OR event_id < stop THEN 'run' WHEN event_id = stop THEN 'back' ELSE 'stay' END AS state FROM events, s""")
def queue_tick(spark, sf):
    return events.tick(_events(spark, sf), F.expr(_NOW)).select("seq", "state")


@query("SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS INTEGER) AS place FROM conversations")
def fifo_messages(spark, sf):
    return events.fifo(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn", "place")


@query("SELECT conv_id, min(turn) AS turn FROM conversations GROUP BY conv_id")
def next_message(spark, sf):
    return events.take_next(table(spark, sf, "conversations"), "conv_id", "turn").select("conv_id", "turn")


# ---------------------------------------------------------------- housekeeping


@query("""SELECT event_type AS target, strftime(ts, '%Y%m%d_%H%M%S') AS version, row_number() OVER (PARTITION BY event_type ORDER BY strftime(ts, '%Y%m%d_%H%M%S') DESC) <= 10 AS keep
    FROM (SELECT DISTINCT event_type, date_trunc('second', ts) AS ts FROM events)""")
def backup_retention(spark, sf):
    versions = table(spark, sf, "events").select(F.col("event_type").alias("target"), F.date_format("ts", "yyyyMMdd_HHmmss").alias("version")).distinct()
    return upkeep.backup_retention(versions, 10)


@query("SELECT doc_id AS path, n_chars AS mtime FROM documents WHERE doc_id % 3 = 0 OR doc_id % 5 = 0")
def backup_changes(spark, sf):
    now = table(spark, sf, "documents").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime"))
    base = now.where("path % 3 <> 0").withColumn("mtime", F.col("mtime") - F.when(F.col("path") % 5 == 0, 1).otherwise(0))
    return upkeep.backup_changes(now, base)


_USERS = "(SELECT c_custkey AS seq, CASE WHEN c_custkey % 10 = 0 THEN '1' ELSE '' END || 'user_' || (c_custkey % 100) AS username FROM customer)"


@query(f"""WITH a AS {_USERS}, ok AS (SELECT username, min(seq) AS first FROM a WHERE regexp_matches(username, '^[a-zA-Z_][a-zA-Z0-9_]{{2,}}$') AND username <> 'user_7' GROUP BY username),
    ids AS (SELECT *, 41 + row_number() OVER (ORDER BY first) AS id FROM ok)
    SELECT seq, a.username, CASE WHEN NOT regexp_matches(a.username, '^[a-zA-Z_][a-zA-Z0-9_]{{2,}}$') THEN 'invalid' WHEN id IS NULL THEN 'duplicate' ELSE 'ok' END AS status, CAST(id AS BIGINT) AS user_id
    FROM a LEFT JOIN ids ON a.username = ids.username AND a.seq = ids.first""")
def users_register(spark, sf):
    k = F.col("c_custkey")
    asked = table(spark, sf, "customer").select(k.alias("seq"), F.concat(F.when(k % 10 == 0, "1").otherwise(""), F.lit("user_"), (k % 100).cast("string")).alias("username"))
    return upkeep.register_users(asked, spark.createDataFrame([("user_7", 41)], "username string, user_id long"))


_LINES = "(SELECT o_custkey AS file, o_orderkey AS line_no, CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN ' k' || (o_orderkey % 8) || ' ' WHEN 1 THEN 's=v' || o_orderkey || '/x' WHEN 2 THEN 's=/z' ELSE 's=w w' END AS line FROM orders)"


@query(rf"""WITH p AS (SELECT file, line_no, line, lag(line) OVER (PARTITION BY file ORDER BY line_no) AS above FROM {_LINES}),
    q AS (SELECT file, line_no, trim(above) AS key, regexp_extract(line, '^s=([^/ \t]*)', 1) AS value FROM p WHERE line LIKE 's=%' AND above NOT LIKE 's=%')
    SELECT file, key, value FROM q WHERE value <> '' QUALIFY row_number() OVER (PARTITION BY file, key ORDER BY line_no) = 1""")
def ini_pairs(spark, sf):
    k = F.col("o_orderkey")
    line = F.when(k % 4 == 0, F.concat(F.lit(" k"), (k % 8).cast("string"), F.lit(" "))).when(k % 4 == 1, F.concat(F.lit("s=v"), k.cast("string"), F.lit("/x"))).when(k % 4 == 2, "s=/z").otherwise("s=w w")
    return upkeep.ini_pairs(table(spark, sf, "orders").select(F.col("o_custkey").alias("file"), k.alias("line_no"), line.alias("line")))


@query("SELECT o_orderkey AS id, coalesce(c_name, CAST(o_custkey AS VARCHAR)) AS sender FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 2 = 0) ON o_custkey = c_custkey")
def rewrite_from(spark, sf):
    pairs = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_name").alias("value"))
    return upkeep.rewrite_from(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("sender")), pairs)


_SENDER = "CASE WHEN o_custkey % 2 = 0 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') ELSE ' ' || o_custkey || ' ' END"


@query(f"""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'x From=' || o_custkey ELSE 'To=me' || chr(10) || 'From=' || {_SENDER} || chr(10) || 'From= ' || o_custkey || chr(10) END AS text
    FROM orders""")
def header_rewrite(spark, sf):
    pairs = table(spark, sf, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("key"), F.concat(F.lit("Customer#"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("value"))
    key = F.col("o_custkey").cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("x From="), key)).otherwise(F.concat(F.lit("To=me\nFrom= "), key, F.lit(" \nFrom= "), key, F.lit("\n")))
    return upkeep.rewrite_headers(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text")), pairs)


@query(rf"""WITH v AS {_VALUES} SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, strftime(o_orderdate, '%H:%M:%S') AS time, o_orderpriority AS request_type, {_SUMMARY} AS request_text, CAST(o_custkey AS VARCHAR) AS user_name
    FROM orders JOIN v ON o_orderkey = id""")
def request_log(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_orderpriority").alias("request_type"), F.expr(_TEXT).alias("request_text"), F.col("o_custkey").cast("string").alias("user_name"))
    return upkeep.request_log(rows)


_UPLOADS = "SELECT page_id AS seq, CASE WHEN page_id % 7 = 0 THEN 'f1(1).txt' ELSE 'f' || (page_id % 8) || CASE WHEN page_id % 2 = 0 THEN '.txt' ELSE '' END END AS name, page_id % 3 AS size FROM pages"


@query(rf"""WITH RECURSIVE u AS (SELECT *, row_number() OVER (ORDER BY seq) AS k, regexp_extract(name, '^(.+?)(\.[^.]*)?$', 1) AS stem, regexp_extract(name, '^(.+?)(\.[^.]*)?$', 2) AS ext FROM ({_UPLOADS})),
    e AS (SELECT DISTINCT 'f' || (page_id % 4) || CASE WHEN page_id % 2 = 0 THEN '.txt' ELSE '' END AS name, CAST(1 AS BIGINT) AS size FROM pages),
    go(k, names, sizes, seq, name, size, saved_as) AS (
        SELECT CAST(0 AS BIGINT), list(name), list(size), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR) FROM e
        UNION ALL
        SELECT k, CASE WHEN free THEN list_append(names, saved_as) ELSE names END, CASE WHEN free THEN list_append(sizes, size) ELSE sizes END, seq, name, size, saved_as FROM (
            SELECT *, NOT list_contains(names, saved_as) AS free FROM (
                SELECT u.k, g.names, g.sizes, u.seq, u.name, u.size, CASE WHEN NOT list_contains(g.names, u.name) OR g.sizes[list_position(g.names, u.name)] = u.size THEN u.name
                    ELSE list_filter(list_transform(range(1, 1001), lambda i: u.stem || '(' || i || ')' || u.ext), lambda c: NOT list_contains(g.names, c))[1] END AS saved_as
                FROM go g JOIN u ON u.k = g.k + 1)))
    SELECT seq, name, size, saved_as FROM go WHERE seq IS NOT NULL""")
def upload_names(spark, sf):
    k = F.col("page_id")
    name = lambda m: F.concat(F.lit("f"), (k % m).cast("string"), F.when(k % 2 == 0, ".txt").otherwise(""))
    pages = table(spark, sf, "pages")
    uploads = pages.select(k.alias("seq"), F.when(k % 7 == 0, "f1(1).txt").otherwise(name(8)).alias("name"), (k % 3).alias("size"))
    return upkeep.upload_names(uploads, pages.select(name(4).alias("name"), F.lit(1).cast("long").alias("size")).distinct())


@query("SELECT CAST(conv_id AS VARCHAR) AS \"user\", CASE WHEN conv_id % 2 = 0 THEN 'box/' || conv_id ELSE 'Operator no found!' END AS folder FROM (SELECT DISTINCT conv_id FROM conversations)")
def attachment_folders(spark, sf):
    users = table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("user")).distinct()
    return upkeep.attachment_folder(users, "box/", users.where(F.col("user").cast("long") % 2 == 0).select("user", F.col("user").alias("suffix")))
