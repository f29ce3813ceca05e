"""Personal data: fixed patterns, and terms that give protected entities away.

Patterns find e-mail addresses, IP addresses, card and phone numbers (base spans, code
points).  Beyond them the corpus itself tells which words reveal such an entity: over all
word positions T, with c(t) occurrences of term t, n(e) word positions near entity value e
and c(t, e) occurrences of t among these,

    PMI(t; e) = log2(c(t, e) * T / (c(t) * n(e))),   IC(e) = -log2(n(e) / T),

and their ratio, 1 where t occurs near e only, is how much of e's information t discloses.
Terms at or above the threshold near an occurrence of e become ``term`` spans, if enough
different contexts show the pair (a copied text is one context); with ``everywhere`` they do
at all their places in all texts.  ``sanitise`` writes
placeholders over base spans and generalises disclosing terms.

All of it is DataFrame functions.  Texts are read once for spans and contexts, which are
written, and once for word counts.

Patterns are written so that no text makes them slow: where a run of characters cannot
begin a match at its head it cannot begin one later in the run either, so matches begin at
a run's head or where the last match ended, and runs are never given back.

Defined results: a null text is empty; null ids and repeated rows need no rule, as spans are
found row by row; an empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, discard, free_name, materialise, roughly_in, word_array

#: Kinds in order and what matches.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WORD = r"[^\x20\x09-\x0D]++"
SPAN = "array<struct<start:int,ord:int,end:int,kind:string>>"
CONTEXT = "array<struct<term:string,start:int,end:int>>"


@dataclass(frozen=True)
class Disclosure:
    """``reach``: characters on each side of an entity whose whole words are its context;
    ``ratio``: PMI / IC from which a term is taken as disclosing; ``contexts``: different
    contexts that must show term and entity together; ``letters``: least length of a term;
    ``everywhere``: whether a disclosing term counts at every place, not only near its entity."""

    reach: int = 48
    ratio: float = 0.9
    contexts: int = 3
    letters: int = 3
    everywhere: bool = False


def _valid(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        part = lambda x: F.regexp_replace(x, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda x: (F.length(part(x)) <= 3) & (F.substring(part(x), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits).between(14, 19) & F.call_function("luhn_check", F.substring(digits, 1, 19))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _hint(kind: str, text: Column) -> Column:
    """Without it there is no match: spares the pattern on most texts."""
    return {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, text.rlike("[0-9]"))


#: Matches whose places are added up in one go.
BLOCK = 256


def located(text: Column, pattern: str, keep, make) -> Column:
    """An array of ``make(start, end, match)`` for the matches that ``keep`` accepts.

    Split pieces and matches alternate, so running lengths give every match its place: inside
    blocks of matches first, then over the blocks, as every step copies what it has so far.
    """
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p, m: F.struct(F.length(p).alias("gap"), m.alias("m")))
    none = F.filter(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("m"))), lambda x: F.lit(False))

    def add(s: Column, x: Column) -> Column:
        start = s["at"] + x["gap"]
        end = start + F.coalesce(F.length(x["m"]), F.lit(0))
        found = F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))
        return F.struct(end.alias("at"), F.when(x["m"].isNotNull() & keep(x["m"]), F.concat(s["out"], found)).otherwise(s["out"]).alias("out"))

    def places(part: Column) -> Column:
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), add)

    def join(s: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda x: F.struct((x["start"] + s["at"]).alias("start"), (x["end"] + s["at"]).alias("end"), x["m"].alias("m")))
        return F.struct((s["at"] + block["at"]).alias("at"), F.concat(s["out"], F.array(moved)).alias("out"))

    def whole(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int")), lambda b: places(F.slice(p, b * BLOCK + 1, F.lit(BLOCK))))
        far = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.filter(F.array(none), lambda x: F.lit(False)).alias("out")), join, lambda s: F.flatten(s["out"]))
        return F.when(F.size(p) <= BLOCK, places(p)["out"]).otherwise(far)

    # The array is bound by a transform over it, so that it is made once and not for every block.
    return F.transform(F.element_at(F.transform(F.array(pairs), whole), 1), lambda x: make(x["start"], x["end"], x["m"]))


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind."""
    found = []
    for i, kind in enumerate(KINDS):
        make = lambda s, e, m, i=i, kind=kind: F.struct(s.alias("start"), F.lit(i).alias("ord"), e.alias("end"), F.lit(kind).alias("kind"))
        spans = located(text, PATTERNS[kind], lambda m, kind=kind: _valid(kind, m), make).cast(SPAN)
        found.append(F.when(_hint(kind, text), spans).otherwise(F.array().cast(SPAN)))
    return F.array_sort(F.concat(*found))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def term_of(word: Column) -> Column:
    """A word as a term: ASCII lower case, no punctuation at its ends."""
    return F.translate(F.regexp_replace(word, r"^[!-/:-@\[-`{-~]+|[!-/:-@\[-`{-~]+$", ""), UPPER, LOWER)


def _around(text: Column, spans: Column, how: Disclosure) -> Column:
    """For each base span: its entity, a hash of its context, and the context's terms with their places."""

    def terms(piece: Column, at: Column) -> Column:
        make = lambda s, e, m: F.struct(term_of(m).alias("term"), (s + at).alias("start"), (e + at).alias("end"))
        return located(piece, WORD, lambda m: F.length(term_of(m)) >= how.letters, make).cast(CONTEXT)

    def one(s: Column) -> Column:
        lo = F.greatest(F.lit(0), s["start"] - how.reach)
        left = F.substring(text, lo + 1, s["start"] - lo)
        right = F.substring(text, s["end"] + 1, F.lit(how.reach))
        # A word that the edge of the window may cut is left out, and one that touches the entity is part of it.
        cut_l = F.when(lo > 0, F.length(F.regexp_extract(left, r"^[^\x20\x09-\x0D]*", 0))).otherwise(0)
        left = F.regexp_replace(F.substring(left, cut_l + 1, F.lit(how.reach)), r"[^\x20\x09-\x0D]+$", "")
        cut_r = F.length(F.regexp_extract(right, r"^[^\x20\x09-\x0D]*", 0))
        right = F.when(F.length(right) < how.reach, right).otherwise(F.regexp_replace(right, r"[^\x20\x09-\x0D]+$", ""))
        right = F.substring(right, cut_r + 1, F.lit(how.reach))
        words = F.concat(terms(left, lo + cut_l), terms(right, s["end"] + cut_r))
        words = F.filter(words, lambda w: ~F.exists(spans, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
        value = F.translate(F.substring(text, s["start"] + 1, s["end"] - s["start"]), UPPER, LOWER)
        value = F.when(s["kind"].isin("card", "phone"), F.regexp_replace(value, "[^0-9]", "")).otherwise(value)
        return F.struct(F.xxhash64(s["kind"], value).alias("entity"), F.xxhash64(left, right).alias("context"), words.alias("words"))

    return F.transform(spans, one)


def _near(seen: DataFrame, telling: DataFrame) -> DataFrame:
    """(row, terms): the spans of disclosing terms in the contexts of their entities."""
    return seen.join(telling, ["term", "entity"]).select("row", F.struct("start", F.lit(len(KINDS)).alias("ord"), "end", F.lit("term").alias("kind")).alias("s")).groupBy("row").agg(F.collect_set("s").alias("terms"))


def _everywhere(rows: DataFrame, telling: DataFrame) -> DataFrame:
    """(row, terms): the spans of disclosing terms at all places that no base span touches.

    Each text's distinct terms meet the disclosing ones first; only texts that hold some are cut into places."""
    each = rows.select("row", F.explode(F.array_distinct(F.transform(word_array(F.col("text_")), term_of))).alias("term"))
    hot = materialise(roughly_in(each, "term", telling).join(telling, "term").groupBy("row").agg(F.collect_set("term").alias("hot")), "hot")
    texts = roughly_in(rows.select("row", "text_", "base"), "row", hot.select("row")).join(hot, "row")
    make = lambda s, e, m: F.struct(s.alias("start"), F.lit(len(KINDS)).alias("ord"), e.alias("end"), F.lit("term").alias("kind"))
    places = located(F.col("text_"), WORD, lambda m: F.array_contains("hot", term_of(m)), make).cast(SPAN)
    clear = lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    return texts.select("row", F.filter(places, clear).alias("terms"))


def find(docs: DataFrame, how: Disclosure = Disclosure(), keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns) with, as its last two columns, arrays ``base`` and
    ``terms`` of spans (with underscores in front where a column has that name)."""
    kept = docs.columns if keep is None else keep
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)), text.alias("text_"))
    rows = slim.withColumn("base", base_spans(F.col("text_")))
    near = F.when(F.size("base") > 0, _around(F.col("text_"), F.col("base"), how))
    rows = rows.withColumn("near", near)
    rows = materialise((rows if how.everywhere else rows.drop("text_")).withColumn("row", F.monotonically_increasing_id()), "spans")

    seen = rows.where("near is not null").select("row", F.explode("near").alias("n")).select("row", "n.entity", "n.context", F.explode("n.words").alias("w")).select("row", "entity", "context", "w.*")
    # Copies of a context are added up first, so a hot pair is summed from partial counts.
    per_context = seen.groupBy("term", "entity", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = per_context.groupBy("term", "entity").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("contexts"))
    near_words = seen.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    often = materialise(pairs.where(F.col("contexts") >= how.contexts).join(near_words, "entity"), "pairs")
    counts = docs.select(F.explode(word_array(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("c"))
    counts = materialise(counts.groupBy(term_of(F.col("word")).alias("term")).agg(F.sum("c").alias("c_t")), "terms")
    total = counts.agg(F.coalesce(F.sum("c_t"), F.lit(0)).cast("double").alias("t"))
    known = often.join(counts, "term").crossJoin(F.broadcast(total))  # one row
    pmi = F.log2(F.col("both") * F.col("t") / (F.col("c_t") * F.col("n_e")))
    telling = materialise(known.where(pmi >= -how.ratio * F.log2(F.col("n_e") / F.col("t"))).select("term", "entity"), "telling")
    discard(often, counts)
    if how.everywhere:
        found = _everywhere(rows, telling.select("term").distinct())
    else:
        found = _near(seen, telling)
    out = rows.join(found, "row", "left")
    terms = F.coalesce(F.array_sort(F.col("terms").cast(SPAN)), F.array().cast(SPAN))
    return out.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(kept)), F.col("base").alias(free_name(kept, "base")), terms.alias(free_name(kept, "terms")))


def sanitise(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """``docs`` with base spans replaced by ``[kind]`` and disclosing terms by ``[term]``."""
    found = find(docs, how)
    spans = F.array_sort(F.concat(*found.columns[-2:]))
    step = lambda s, x: F.struct(
        F.greatest(s["at"], x["end"]).alias("at"),
        F.when(x["start"] >= s["at"], F.concat(s["out"], F.substring("text", s["at"] + 1, x["start"] - s["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(s["out"]).alias("out"))
    clean = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substring("text", s["at"] + 1, F.length("text"))))
    return found.select(*(clean.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns))


def personal_data(docs: DataFrame, how: Disclosure = Disclosure()) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term for every row of ``docs``."""
    found = find(docs.select("doc_id", "text"), how, ["doc_id"])
    n = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(n, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "terms"))).alias("spans"), F.size("terms").cast("long").alias("n_term"))
