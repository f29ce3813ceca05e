"""Ranked search over postings: any word or all words of a request, for many requests at once.

Sizes decide how the request words are joined; nothing is broadcast by force.  Few words become
a filter that reaches the scan of a saved index, which is clustered by word.  One ordering
gives ranks and the greatest sum, and the top of each request is cut before rows are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions import text as T
from tessera.operators.index import number_rows


#: Distinct request words up to which they become a filter that reaches the scan of the postings.
FEW_WORDS = 1000


def _asked(requests: DataFrame, config: EngineConfig) -> DataFrame:
    asked = requests.select("request_id", T.query_words(F.col("request"), config.normalize_query).alias("ws"))
    return asked.select("request_id", F.size("ws").alias("asked"), F.explode("ws").alias("word"))


def _narrowed(table: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of ``table`` with a word that is asked for: by a filter that prunes row groups where the
    words are few, else by a join that Spark plans by size."""
    words = asked.select("word").distinct()
    few = [r["word"] for r in words.limit(FEW_WORDS + 1).collect()]
    return table.where(F.col("word").isin(few)) if len(few) <= FEW_WORDS else table.join(words, "word", "left_semi")


def search(postings: DataFrame, requests: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(request_id, file_id, hits, relevance, rank) for ``requests`` (request_id, request).

    hits: occurrences of the request's distinct words; relevance: hits over the greatest hits
    of any candidate; ties go to the lower file_id.
    """
    asked = _asked(requests, config)
    hits = asked.join(_narrowed(postings, asked), "word").groupBy("request_id", "asked", "file_id").agg(F.sum("cnt").alias("hits"), F.count(F.lit(1)).alias("matched"))
    if config.exact:
        hits = hits.where("matched = asked")
    if config.limit > 0:  # a request's top is cut in each task before rows meet
        order = Window.partitionBy("request_id").orderBy(F.desc("hits"), "file_id")
        best = F.first("hits").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        ranked = hits.select("request_id", "file_id", "hits", F.row_number().over(order).alias("rank"), best.alias("best")).where(F.col("rank") <= config.limit)
    else:  # all candidates of all requests in one sorted numbering, so no request is one task
        numbered = number_rows(hits.select("request_id", "file_id", "hits", (-F.col("hits")).alias("less")), ["request_id", "less", "file_id"])
        tops = numbered.groupBy("request_id").agg(F.max("hits").alias("best"), F.min("n").alias("first"))
        ranked = numbered.join(tops, "request_id").select("request_id", "file_id", "hits", (F.col("n") - F.col("first") + 1).cast("int").alias("rank"), "best")
    relevance = (F.col("hits").cast("float") / F.col("best").cast("float")).cast("float")
    return ranked.select("request_id", "file_id", "hits", relevance.alias("relevance"), "rank")


def search_texts(docs: DataFrame, requests: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """``search`` over texts (file_id, text) without an index: words that nobody asks for are dropped
    before anything is grouped."""
    each = docs.select("file_id", F.explode(T.words(F.col("text"))).alias("word"))
    wanted = _narrowed(each, _asked(requests, config))
    return search(wanted.groupBy("word", "file_id").agg(F.count(F.lit(1)).alias("cnt")), requests, config)


def with_paths(found: DataFrame, files: DataFrame) -> DataFrame:
    return found.join(files.select("file_id", "path"), "file_id")


def text_lines(found: DataFrame) -> DataFrame:
    """(request_id, rank, line) with line ``path;relevance`` of six digits.  The relevance's exact value
    counts, and one that lies in the middle goes to the even digit (1/128 is 0.007812)."""
    exact = F.bround(F.col("relevance").cast("double").cast("decimal(38,25)"), 6).cast("decimal(20,6)").cast("string")
    return found.select("request_id", "rank", F.concat_ws(";", "path", exact).alias("line"))


def _quoted(c) -> Column:
    """A text as JSON."""
    whole = F.to_json(F.struct(c.alias("p")))
    return whole.substr(F.lit(6), F.length(whole) - 6)


def answers(requests: DataFrame, found: DataFrame, use_text: bool = False) -> DataFrame:
    """(label, body): a row a request, body as JSON {"result": .., "relevance": [[path, rel], ..]}.

    Labels are request numbers or texts; of requests with the same text the last counts.
    A request's list has ``limit`` answers at most.
    """
    lists = found.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "path", F.col("relevance").cast("double").alias("rel")))).alias("l"))
    label = F.col("request") if use_text else T.request_label(F.col("request_id"))
    rows = requests.select("request_id", label.alias("label"))
    last = rows.groupBy("label").agg(F.max("request_id").alias("request_id")).join(lists, "request_id", "left")
    pairs = F.concat_ws(",", F.transform("l", lambda x: F.concat(F.lit("["), _quoted(x["path"]), F.lit(","), x["rel"].cast("string"), F.lit("]"))))
    body = F.when(F.size("l") > 0, F.concat(F.lit('{"result":true,"relevance":['), pairs, F.lit("]}"))).otherwise('{"result":false}')
    return last.select("label", body.alias("body"))


def write_answers(rows: DataFrame, path: str) -> None:
    """Sink: one file {"Answers": {label: body, ..}} of ``answers``, written row by row."""
    import json

    with open(path, "w", encoding="utf-8") as out:
        out.write('{"Answers":{')
        for i, r in enumerate(rows.orderBy("label").toLocalIterator()):
            out.write(f"{',' if i else ''}{json.dumps(r['label'], ensure_ascii=False)}:{r['body']}")
        out.write("}}")


def request_changed(text: str, last: str | None) -> tuple[bool, str]:
    """Whether a request file's text differs from the one of digest ``last``, and its own digest."""
    import hashlib

    now = hashlib.sha256(text.encode()).hexdigest()
    return now != last, now


def requests_from_json(df: DataFrame, column: str, keep: list[str] = ()) -> DataFrame:
    """(.. ``keep``, request_id, request) of {"Requests": [..]} texts; broken JSON has no requests."""
    listed = df.select(*keep, F.from_json(column, "Requests array<string>").alias("j"))
    return listed.select(*keep, F.posexplode("j.Requests").alias("n", "request")).select(*keep, (F.col("n") + 1).alias("request_id"), "request")
