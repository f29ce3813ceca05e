"""Quality rules by repetition coverage.

For every text, rolling hashes of several n-gram lengths (numpy) mark the n-grams that
occur twice or more; the characters of the words they cover, and those of repeated lines,
are set against all word characters.  A text is rejected when one coverage exceeds its
bound, when it has too many mark-up symbols for its words, or when it fails the base rule.

Defined results: a null or empty text has no words and fails the base rule; each row is
judged alone, so ties, repeated rows and null ids need no rule; an empty table gives an
empty table; further columns pass through, and a column that is already called
``quality`` keeps its name while ours gets underscores in front.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import free_name, mix, ngram_hashes, per_text

SYMBOLS = b"#*$%&|<>"
FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, dup_5gram_chars long, dup_7gram_chars long, dup_10gram_chars long"


@dataclass(frozen=True)
class Rules:
    """Bounds: at least ``min_words`` words; at most these percentages of word characters
    (of words, for the base rule and for symbols) may be repeated."""

    min_words: int = 50
    repeat_words_pct: int = 50
    dup_line_pct: int = 30
    dup_5gram_pct: int = 45
    dup_7gram_pct: int = 40
    dup_10gram_pct: int = 35
    symbols_pct: int = 25


def _twice(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs more than once."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    step = np.zeros(size + 1, np.int32)
    step[: len(starts)] += starts
    step[n : n + len(starts)] -= starts
    return np.cumsum(step[:size]) > 0


def measure(raw: bytes) -> tuple[int, ...]:
    """The numbers of FIELDS for one text."""
    words = raw.split()
    n = len(words)
    if not n:
        return (0, 0, len(raw) - len(raw.translate(None, SYMBOLS)), 0, 0, 0, 0, 0, 0)
    table = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(table.__getitem__, words), np.uint64, n)
    wide = raw.isascii()
    lens = np.fromiter((len(w) if wide or w.isascii() else len(w.decode("utf-8", "replace")) for w in table), np.int64, len(table))[ids.astype(np.int64)]
    chars = int(lens.sum())

    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line in seen:
                dup_lines += 1
                dup_line_chars += sum(len(w.decode("utf-8", "replace")) for w in line.split())
            elif line.strip():
                seen.add(line)

    # Windows of three words are compared exactly: three numbers of 21 bits, or else ranks of pairs.
    repeat = 0
    cover = [0, 0, 0]
    if n >= 3 and len(table) < n:
        if len(table) < 1 << 21:
            keys = (ids[:-2] << np.uint64(42)) | (ids[1:-1] << np.uint64(21)) | ids[2:]
        else:
            pair = np.unique((ids[:-1] << np.uint64(32)) | ids[1:], return_inverse=True)[1].astype(np.uint64)
            keys = (pair[:-1] << np.uint64(32)) | ids[2:]
        twice = _twice(keys)
        if twice.any():
            repeat = int(_covered(twice, 3, n).sum())
            hashed = mix(ids)
            for k, size in enumerate((5, 7, 10)):
                again = _twice(ngram_hashes(hashed, size)) if n >= size else np.zeros(0, bool)
                if not again.any():
                    break  # a repeated longer n-gram would hold a repeated shorter one
                cover[k] = int(lens[_covered(again, size, n)].sum())
    return (n, chars, len(raw) - len(raw.translate(None, SYMBOLS)), dup_lines, repeat, dup_line_chars, *cover)


def _worker():
    def work(texts: list[bytes]) -> list[list[int]]:
        return [list(x) for x in zip(*map(measure, texts), strict=True)]

    return work


def assess(docs: DataFrame, text: str = "text", keep: list[str] | None = None, rules: Rules = Rules()) -> DataFrame:
    """``docs`` (its ``keep`` columns) with a struct column ``quality``: FIELDS, base_failed and kept."""
    import pyspark.sql.types as T

    kept = docs.columns if keep is None else keep
    names = [f.split()[0] for f in FIELDS.split(", ")]
    own = [free_name(kept, f"_q_{x}") for x in names]
    out = per_text(docs, text, ", ".join(f"`{o}` long" for o in own), _worker, kept)
    q = {x: F.col(f"`{o}`") for x, o in zip(names, own, strict=True)}
    failed = (q["n_words"] < rules.min_words) | (100 * q["n_repeat_words"] > rules.repeat_words_pct * q["n_words"])
    over = (100 * q["n_symbols"] > rules.symbols_pct * q["n_words"])
    for x, most in (("dup_line_chars", rules.dup_line_pct), ("dup_5gram_chars", rules.dup_5gram_pct), ("dup_7gram_chars", rules.dup_7gram_pct), ("dup_10gram_chars", rules.dup_10gram_pct)):
        over |= 100 * q[x] > most * q["word_chars"]
    struct = F.struct(*(q[x].alias(x) for x in names), failed.alias("base_failed"), (~failed & ~over).alias("kept"))
    return out.select(*(f"`{c}`" for c in kept), struct.alias(free_name(kept, "quality")))


def keep_good(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that pass, with its columns."""
    out = assess(docs, text, rules=rules)
    return out.where(F.col(f"`{out.columns[-1]}`.kept")).select(*(f"`{c}`" for c in docs.columns))


def assess_sql(rules: Rules = Rules()) -> str:
    """The same numbers and verdicts for DuckDB, over ``documents`` (doc_ids apart)."""
    word = r"[^\x20\x09-\x0D]+"

    def covered(n: int) -> str:
        """Words (doc_id, i) inside n-grams that occur twice in their text."""
        grams = f"SELECT doc_id, i, array_to_string(ws[i + 1:i + {n}], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - {n - 1})) AS i FROM w WHERE len(ws) >= {n})"
        return f"(SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k) AS held FROM ({grams})) WHERE held > 1)"

    chars = lambda n: f"c{n} AS (SELECT doc_id, sum(length(x)) AS n FROM u JOIN {covered(n)} USING (doc_id, i) GROUP BY doc_id)"
    over = " OR ".join(f"100 * {x} > {most} * word_chars" for x, most in (("dup_line_chars", rules.dup_line_pct), ("dup_5gram_chars", rules.dup_5gram_pct), ("dup_7gram_chars", rules.dup_7gram_pct), ("dup_10gram_chars", rules.dup_10gram_pct)))
    long = lambda x, name: f"CAST(coalesce({x}, 0) AS BIGINT) AS {name}"
    return f"""
        WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{word}') AS ws FROM documents),
        u AS (SELECT doc_id, unnest(ws) AS x, unnest(range(0, len(ws))) AS i FROM w),
        lines AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS nth FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS i FROM w)),
        again AS (SELECT doc_id, count(*) AS n, sum(list_sum(list_transform(regexp_extract_all(line, '{word}'), lambda x: length(x)))) AS c FROM lines WHERE nth > 1 AND regexp_matches(line, '{word}') GROUP BY doc_id),
        c3 AS (SELECT doc_id, count(*) AS n FROM {covered(3)} GROUP BY doc_id), {chars(5)}, {chars(7)}, {chars(10)},
        m AS (SELECT w.doc_id, {long("len(ws)", "n_words")}, {long("list_sum(list_transform(ws, lambda x: length(x)))", "word_chars")}, {long("length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g'))", "n_symbols")},
            {long("again.n", "n_dup_lines")}, {long("c3.n", "n_repeat_words")}, {long("again.c", "dup_line_chars")}, {long("c5.n", "dup_5gram_chars")}, {long("c7.n", "dup_7gram_chars")}, {long("c10.n", "dup_10gram_chars")}
            FROM w LEFT JOIN again USING (doc_id) LEFT JOIN c3 USING (doc_id) LEFT JOIN c5 USING (doc_id) LEFT JOIN c7 USING (doc_id) LEFT JOIN c10 USING (doc_id)),
        f AS (SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_words_pct} * n_words AS base_failed FROM m)
        SELECT *, NOT base_failed AND NOT (100 * n_symbols > {rules.symbols_pct} * n_words OR {over}) AS kept FROM f"""
