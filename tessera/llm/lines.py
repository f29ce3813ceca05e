"""Line dedup by a deletion-neighbourhood join.

Lines are compared as their words.  A line goes when an equal line, or one within an edit
of one word (inserted, deleted or replaced), comes earlier in the corpus; earliest means
the least doc_id, then the least line number.

* Equal lines are grouped by a 128-bit hash; each group keeps its earliest line.
* A line of n words has, for every place j, the key of its words without word j, and the
  key of all its words cut at j; keys hold j and how many words remain.  Two lines of the
  same key differ by at most one word at one place, so each key's lines all go but the
  earliest; no pairs are made within a key.  Keys come from hash chains over the words from
  both ends, in blocks, so a line's keys cost time in proportion to its words.
* Lines within one word of each other share their first or their last half (of the longer),
  and the edit is in the other one.  Only lines that share a half with another emit keys,
  and only those of places outside the shared half; no link is lost by that.
* Every line that goes is compared with the line it yields to, word by word.

All of it is DataFrame functions; of hot lines only partial minima are shuffled.

Defined results: lines without words always stay; the edit bound holds from ``fuzzy`` words
on (five: one word of five is a similarity of 0.8), shorter lines must be equal; a null text
is empty and stays null; rows alike in doc_id and text are one document for the order, and
are treated alike; null ids come last in the order; an empty table gives an empty table;
further columns pass through ``dedup_lines``.  A document that loses all words it had is dropped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import discard, free_name, materialise, roughly_in

#: Words whose hash chain is built in one go.
BLOCK = 256


@dataclass(frozen=True)
class Lines:
    """Words from which a line can go at all, and from which one edited word is forgiven."""

    least: int = 1
    fuzzy: int = 5


def _lines(text: Column) -> Column:
    """Lines of a text (null: empty) whose separators are all spaces, so that no pattern is needed to cut words."""
    return F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t\x0B\f\r]", " "), "\n")


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, " "), "")


def _has_words(line: Column, least: int) -> Column:
    return F.trim(line) != "" if least <= 1 else F.size(_words(line)) >= least


def _joined(line: Column) -> Column:
    """A line's words with one space between them."""
    return F.when(F.contains(line, F.lit("  ")), F.regexp_replace(F.trim(line), " +", " ")).otherwise(F.trim(line))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("rk"))


def _halves(line: Column, n: Column) -> list[Column]:
    """Hashes of the first and last halves under both lengths that a partner one word away may need."""
    out = []
    for half in (F.floor(n / 2).cast("int"), F.floor((n + 1) / 2).cast("int")):
        out += [F.xxhash64(F.lit(0), half, F.call_function("substring_index", line, F.lit(" "), half)), F.xxhash64(F.lit(1), half, F.call_function("substring_index", line, F.lit(" "), -half))]
    return out


def first_lines(docs: DataFrame, how: Lines) -> DataFrame:
    """Each distinct line once (l1, l2, n, halves a..d), at its earliest place ``at``.

    Lines are taken as joined words, so hashes read bytes and no line is cut into words."""
    lines = _keyed(docs).select("doc_id", "rk", F.posexplode(_lines(F.col("text"))).alias("no", "line")).where(F.trim("line") != "")
    lines = lines.select("doc_id", "rk", "no", _joined(F.col("line")).alias("line"))
    lines = lines.select("*", (F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1).alias("n")).where(F.col("n") >= how.least)
    fuzzy, odd = F.col("n") >= how.fuzzy, F.col("n") % 2 == 1  # an even number of words has but one half
    halves = [F.when(fuzzy & odd if x in "cd" else fuzzy, h).alias(x) for x, h in zip("abcd", _halves(F.col("line"), F.col("n")), strict=True)]
    at = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "rk", "no").alias("at")
    keys = lines.select(F.xxhash64("line").alias("l1"), F.xxhash64("line", F.lit(7)).alias("l2"), "n", *halves, at)
    return keys.groupBy("l1", "l2").agg(F.min("at").alias("at"), *(F.max(c).alias(c) for c in "nabcd"))


def _chain(w: Column) -> Column:
    """Hashes of the first 0, 1, ... n words.  What follows the first block is hashed on its
    block's own chain and on all before the block, so no long array is copied word by word."""
    inner = lambda part: F.aggregate(part, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.xxhash64(F.element_at(acc, -1), x))))
    blocks = F.transform(F.sequence(F.lit(1), F.floor((F.size(w) - 1) / BLOCK).cast("int")), lambda b: inner(F.slice(w, b * BLOCK + 1, F.lit(BLOCK))))
    first = inner(F.slice(w, F.lit(1), F.lit(BLOCK)))
    start = F.struct(F.element_at(first, -1).alias("head"), F.array(first).alias("out"))

    def add(s: Column, chain: Column) -> Column:
        hashed = F.transform(F.slice(chain, F.lit(2), F.lit(BLOCK)), lambda h: F.xxhash64(s["head"], h))
        return F.struct(F.element_at(hashed, -1).alias("head"), F.concat(s["out"], F.array(hashed)).alias("out"))

    return F.when(F.size(w) <= BLOCK, inner(w)).otherwise(F.aggregate(blocks, start, add, lambda s: F.flatten(s["out"])))


def _keys(texts: DataFrame) -> DataFrame:
    """(id, key, j, m): keys of lines (id, w, front, back: whether a first or last half is shared)."""
    chains = texts.select("id", "front", "back", F.size("w").alias("n"), _chain(F.col("w")).alias("x"), F.reverse(_chain(F.reverse("w"))).alias("y"))
    n, half = F.col("n"), F.floor(F.col("n") / 2).cast("int")
    lo, hi = F.when(F.col("back"), 0).otherwise(half), F.when(F.col("front"), n).otherwise(n - half)
    key = lambda j, m, after: F.struct(j.alias("j"), m.alias("m"), F.xxhash64(j, m, F.get("x", j), F.get("y", after)).alias("key"))
    without = F.transform(F.sequence(lo, F.least(hi, n - 1)), lambda j: key(j, n - 1, j + 1))
    cut = F.transform(F.sequence(lo, hi), lambda j: key(j, n, j))
    return chains.select("id", F.explode(F.concat(without, cut)).alias("k")).select("id", "k.*")


def one_word_apart(first: DataFrame, docs: DataFrame) -> DataFrame:
    """(l1, l2) of the distinct lines that yield to an earlier one within one word."""
    each = F.when(F.col("n") % 2 == 0, F.array("a", "b")).otherwise(F.array("a", "b", "c", "d"))
    halves = first.where("a is not null").select("l1", "l2", F.posexplode(each).alias("k", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    some = halves.join(shared, "half", "left_semi").groupBy("l1", "l2").agg(F.max(F.col("k") % 2 == 0).alias("front"), F.max(F.col("k") % 2 == 1).alias("back"))
    # Numbers in the order of places stand for them from here on.
    place = first.join(some, ["l1", "l2"]).select("l1", "l2", "at", "front", "back").repartitionByRange("at", "l1").sortWithinPartitions("at", "l1")
    place = materialise(place.select(F.monotonically_increasing_id().alias("id"), "l1", "l2", F.col("at.doc_id").alias("p_id"), F.col("at.rk").alias("p_rk"), "at.no", "front", "back"), "places")
    whole = roughly_in(_keyed(docs), "rk", place.select("p_rk")).select("doc_id", "rk", _lines(F.col("text")).alias("lines"))
    found = place.join(whole, (F.col("p_rk") == F.col("rk")) & F.col("p_id").eqNullSafe(F.col("doc_id")))
    texts = materialise(found.select("id", "front", "back", F.element_at("lines", F.col("no") + 1).alias("line")).dropDuplicates(["id"]).select("id", "front", "back", _words(F.col("line")).alias("w")), "lines")

    keys = materialise(_keys(texts), "keys")
    lead = keys.groupBy("key").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last").select("key", "lead")
    pairs = keys.join(lead, "key").where("id <> lead").select("id", "lead", "j", "m").distinct()

    rest = lambda w: F.when(F.size(w) > F.col("m"), F.concat(F.slice(w, F.lit(1), F.col("j")), F.slice(w, F.col("j") + 2, F.size(w)))).otherwise(F.col(w))
    other = texts.select(F.col("id").alias("lead"), F.col("w").alias("v"))
    checked = pairs.join(texts.select("id", "w"), "id").join(other, "lead").where(rest("w") == rest("v"))
    out = materialise(checked.select("id").distinct().join(place, "id").select("l1", "l2"), "gone")
    discard(place, texts, keys)
    return out


def kept_lines(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """(doc_id, rk, stay): the numbers of the lines (of enough words) that stay in each document."""
    first = materialise(first_lines(docs, how), "first")
    gone = one_word_apart(first, docs)
    stay = first.join(gone, ["l1", "l2"], "left_anti").select("at.doc_id", "at.rk", "at.no")
    out = materialise(stay.groupBy("doc_id", "rk").agg(F.collect_list("no").alias("stay")), "stay")
    discard(first, gone)
    return out


def _matched(docs: DataFrame, kept: DataFrame) -> DataFrame:
    other = kept.toDF("k_id", "k_rk", "stay")
    return docs.join(other, (F.col("rk") == F.col("k_rk")) & F.col("doc_id").eqNullSafe(F.col("k_id")), "left").drop("k_id", "k_rk")


def _numbers(lines: Column, which) -> Column:
    """Numbers of the lines for which ``which`` holds."""
    return F.filter(F.transform(lines, lambda x, i: F.when(which(x), i).otherwise(-1)), lambda i: i >= 0)


def line_report(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed: sorted line numbers from 0) for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    kept = kept_lines(docs, how)
    cut = _keyed(docs).select("doc_id", "rk", _lines(F.col("text")).alias("lines"))
    slim = cut.select("doc_id", "rk", F.size("lines").alias("n_lines"), _numbers(F.col("lines"), lambda x: _has_words(x, how.least)).alias("open"))
    out = _matched(slim, kept)
    removed = F.array_except("open", F.coalesce("stay", F.array().cast("array<int>")))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """``docs`` without the lines that go; documents that had words and lose them all go too."""
    kept = kept_lines(docs.select("doc_id", "text"), how)
    rk, stay, cut, new, k_id, k_rk = (free_name(docs.columns, x) for x in ("rk", "stay", "cut", "new", "k_id", "k_rk"))
    keyed = docs.withColumn(rk, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    other = kept.toDF(k_id, k_rk, stay)
    both = keyed.join(other, (F.col(rk) == F.col(k_rk)) & keyed["doc_id"].eqNullSafe(F.col(k_id)), "left").withColumn(cut, F.split("text", "\n"))
    blank = _numbers(_lines(F.col("text")), lambda x: ~_has_words(x, how.least))
    numbers = F.array_sort(F.concat(blank, F.coalesce(F.col(stay), F.array().cast("array<int>"))))
    # Lines are cut once a row: a column of its own that is used twice is not computed for each line.
    both = both.withColumn(new, F.when(F.size(cut) > 0, F.array_join(F.transform(numbers, lambda i: F.get(cut, i)), "\n")))
    has_words = lambda c: F.col(c).rlike(r"[^\x20\x09-\x0D]")
    return both.where(F.col("text").isNull() | has_words(new) | ~has_words("text")).select(*(F.col(new).alias("text") if c == "text" else keyed[c] for c in docs.columns))


def report_sql(how: Lines = Lines()) -> str:
    """``line_report`` for DuckDB, over ``documents`` (doc_ids apart), with ``removed`` as joined text: all
    lines in one order, and every line's words with one left out or one place open."""
    word = r"[^\x20\x09-\x0D]+"
    key = "md5(array_to_string(list_concat(ws[1:j], ws[j + {}:]), ' '))"
    return f"""
        WITH docs AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, no, ws, array_to_string(ws, ' ') AS k, row_number() OVER (ORDER BY doc_id, no) AS pos
            FROM (SELECT doc_id, no, regexp_extract_all(line, '{word}') AS ws FROM (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS no FROM docs)) WHERE len(ws) >= {how.least}),
        first AS (SELECT k, any_value(ws) AS ws, min(pos) AS pos FROM lines GROUP BY k),
        keys AS (SELECT k, pos, j, {key.format(2)} AS rest FROM (SELECT *, unnest(range(0, len(ws))) AS j FROM first WHERE len(ws) >= {how.fuzzy})
            UNION ALL SELECT k, pos, j, {key.format(1)} FROM (SELECT *, unnest(range(0, len(ws) + 1)) AS j FROM first WHERE len(ws) >= {how.fuzzy})),
        gone AS (SELECT DISTINCT k FROM (SELECT k, pos, min(pos) OVER (PARTITION BY j, rest) AS lead FROM keys) WHERE lead < pos),
        removed AS (SELECT l.doc_id, count(*) AS n, string_agg(CAST(l.no AS VARCHAR), ',' ORDER BY l.no) AS r FROM lines l JOIN first f ON l.k = f.k LEFT JOIN gone g ON l.k = g.k WHERE l.pos <> f.pos OR g.k IS NOT NULL GROUP BY l.doc_id)
        SELECT doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(r, '') AS removed FROM docs LEFT JOIN removed USING (doc_id)"""
