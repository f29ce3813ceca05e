"""Near-duplicate documents by SuperMinHash, banding, verification and components.

* A text becomes the set of hashes of its distinct word shingles.  Every element walks a
  random permutation of the signature's slots; in step j it offers j plus a fraction to
  one slot.  All elements of a chunk of texts take step j together (numpy), and a text
  stops as soon as all its slots hold less than j + 1, since later steps cannot lower them.
* Texts with equal sets are one class, so copies cost one row in all that follows.
* Classes that agree in a band meet under its key.  Each key's members are compared with
  the member that shares most keys with others (a star, not all pairs).  Where a key still
  joins several components, members of different components meet once more in an exact
  prefix join over their shingles, rarest first.
  Four bit planes of the signature leave out pairs whose estimate is more than six
  standard deviations under the threshold; all others are confirmed on full sets.
* Components come from alternating stars; copies take their class's component.

Defined results: texts without words (null, empty) have empty sets and link with nothing;
rows that share a doc_id are one document; rows without doc_id stand alone, with a null
component, and are kept; an empty table gives an empty table; further columns are ignored
by the query and pass through ``drop_near_duplicates``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import LOWER, UPPER, chunks, discard, materialise, mix, ngram_hashes, per_text, roughly_in, word_stream
from tessera.llm.components import connected_components, joined_components


@dataclass(frozen=True)
class Near:
    """Links need 100 * intersection >= ``percent`` * union.  ``slots`` in bands of ``rows``;
    ``agree``: slots whose four bits must agree for a pair to be confirmed on full sets
    (at 85 % similarity fewer than 38 of 64 agree once in 10**8 pairs)."""

    words: int = 5
    percent: int = 85
    slots: int = 64
    rows: int = 4
    agree: int = 38


NEAR = Near()


def shingle_sets(texts: list[bytes], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text: n-grams of its words, or all words as one where there are fewer."""
    h, sizes = word_stream(texts)
    s = ngram_hashes(h, size)
    out = []
    for end, n in zip(np.cumsum(sizes), sizes, strict=True):
        if n >= size:
            out.append(np.unique(s[end - n : end - size + 1]))
        elif n:
            out.append(ngram_hashes(mix(h[end - n : end] + np.uint64(n)), n))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def super_min_hash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures (one row of ``m`` slots for each set): step in the high half, fraction in the low."""
    n = len(sets)
    sig = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    size = np.fromiter(map(len, sets), np.int64, n)
    x = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(n), size)
    perm = None
    low = np.uint64(0xFFFFFFFF)
    for j in range(m):
        if not len(x):
            break
        draw = mix(x + np.uint64((j + 1) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((draw >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            row = np.arange(len(x))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
        np.minimum.at(sig, doc * m + slot, (draw & low) | np.uint64(j << 32))
        going = sig.reshape(n, m).max(axis=1) >= np.uint64((j + 1) << 32)
        stay = going[doc]
        if perm is None:
            x, doc, k = x[stay], doc[stay], k[stay]
            perm = np.tile(np.arange(m, dtype=np.uint8), (len(x), 1))
            perm[np.arange(len(x)), k] = 0
        elif not stay.all():
            x, doc, perm = x[stay], doc[stay], perm[stay]
    return sig.reshape(n, m)


def band_keys(sig: np.ndarray, rows: int) -> np.ndarray:
    n, m = sig.shape
    keys = mix(np.arange(m // rows, dtype=np.uint64)[None, :] + np.uint64(977)).repeat(n, axis=0)
    for r in range(rows):
        keys = mix(keys ^ mix(sig[:, r::rows][:, : m // rows]))
    return keys


def bit_planes(sig: np.ndarray) -> list[np.ndarray]:
    """Four words of one bit for each slot: a small hash of the slot's value."""
    h = mix(sig)
    return [np.packbits((h >> np.uint64(b) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)[:, 0] for b in range(4)]


def signatures(docs: DataFrame, near: Near = NEAR, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of ``docs`` with set size, set fingerprint (h1, h2), bit planes p1..p4 and band keys."""

    def make():
        def work(texts: list[bytes]) -> list:
            sets = shingle_sets(texts, near.words)
            size = np.fromiter(map(len, sets), np.int64, len(sets))
            sig = super_min_hash(sets, near.slots)
            keys = band_keys(sig, near.rows)
            with np.errstate(over="ignore"):
                prints = [np.fromiter((int(mix(s ^ np.uint64(salt)).sum(dtype=np.uint64)) for s in sets), np.uint64, len(sets)).view(np.int64) for salt in (0x51ED270B, 0xA24BAED4963EE407)]
            full = size > 0
            offsets = np.concatenate(([0], np.cumsum(full * keys.shape[1]))).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[full].reshape(-1).view(np.int64)))
            return [pa.array(size), *map(pa.array, prints), *map(pa.array, bit_planes(sig)), bands]

        return work

    return per_text(docs, "text", "n_shingles long, h1 long, h2 long, p1 long, p2 long, p3 long, p4 long, bands array<long>", make, keep)


def alike(near: Near):
    """Whether the bit planes of a pair (x_p1.., y_p1..) agree in enough slots."""
    differ = F.lit(0).cast("long")
    for p in ("p1", "p2", "p3", "p4"):
        differ = differ.bitwiseOR(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}")))
    sizes = (100 * F.least("x_n", "y_n") >= near.percent * F.greatest("x_n", "y_n"))
    return sizes & (F.bit_count(differ) <= near.slots - near.agree)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents in ``ids`` (doc_id)."""
    return roughly_in(docs.select("doc_id", "text"), "doc_id", ids).join(ids, "doc_id", "left_semi")


def shingles_of(docs: DataFrame, ids: DataFrame, near: Near) -> DataFrame:
    """(rep, shingle): the sets of the documents in ``ids`` (doc_id)."""
    texts = texts_of(docs, ids)

    def run(batches):
        for part, texts in chunks(batches, "text"):
            sets = shingle_sets(texts, near.words)
            of = pa.array(np.repeat(np.arange(len(sets)), list(map(len, sets))))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")).take(of), pa.array(flat.view(np.int64))], names=["rep", "shingle"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return texts.mapInArrow(run, f"rep {id_type}, shingle long")


def open_pairs(members: DataFrame, docs: DataFrame, near: Near) -> DataFrame:
    """(a, b): pairs of ``members`` (rep, n, p1..p4, part) of different parts that may be links.

    Sets are ordered by how few members have a shingle.  A similar pair shares a shingle
    near the head of both orders, and what stands behind the first shared one bounds their
    intersection; so copies that each have edits of their own do not meet.  Shingles that
    only members of one part have near the head join nothing.
    """
    each = materialise(shingles_of(docs, members.select(F.col("rep").alias("doc_id")).distinct(), near), "shingles")
    held = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"))
    place = F.row_number().over(Window.partitionBy("rep").orderBy("held", "shingle")) - 1
    head = each.join(held, "shingle").withColumn("i", place).join(members, "rep").where("held > 1").where(100 * (F.col("n") - F.col("i")) >= near.percent * F.col("n"))
    head = head_table = materialise(head, "heads")
    across = head.groupBy("shingle").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("shingle")
    head = head.join(across, "shingle")
    cols = ("shingle", "rep", "n", "i", "part", "p1", "p2", "p3", "p4")
    x, y = (head.select(*(F.col(c).alias(f"{side}_{c}") for c in cols)) for side in "xy")
    behind = F.least(F.col("x_n") - F.col("x_i"), F.col("y_n") - F.col("y_i"))
    enough = 100 * behind >= near.percent * (F.col("x_n") + F.col("y_n") - behind)
    on = (F.col("x_shingle") == F.col("y_shingle")) & (F.col("x_part") < F.col("y_part")) & enough & alike(near)
    out = materialise(x.join(y, on).select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct(), "pairs")
    discard(each, head_table)
    return out


def confirm(pairs: DataFrame, docs: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) of ids whose texts' full sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    texts = materialise(texts_of(docs, wanted), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")

    def run(batches):
        known: dict[bytes, np.ndarray] = {}

        def of(raw: bytes) -> np.ndarray:
            if raw not in known:
                if len(known) >= 64:
                    known.pop(next(iter(known)))
                known[raw] = shingle_sets([raw], near.words)[0]
            return known[raw]

        for batch in batches:
            a, b, x, y = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "x", "y"))
            yes = []
            for s, t in zip(x.cast(pa.binary()).to_pylist(), y.cast(pa.binary()).to_pylist(), strict=True):
                s, t = of(s or b""), of(t or b"")
                common = len(np.intersect1d(s, t, assume_unique=True))
                yes.append(bool(common) and 100 * common >= near.percent * (len(s) + len(t) - common))
            keep = pa.array(yes, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    out = materialise(both.select("a", "b", "x", "y").mapInArrow(run, pairs.select("a", "b").schema).distinct(), "links")
    discard(texts)
    return out


def _pairs(left: DataFrame, right: DataFrame, near: Near) -> DataFrame:
    """Distinct pairs of different members under one key that look alike."""
    cols = ("key", "rep", "n", "p1", "p2", "p3", "p4")
    x, y = left.select(*(F.col(c).alias(f"x_{c}") for c in cols)), right.select(*(F.col(c).alias(f"y_{c}") for c in cols))
    on = (F.col("x_key") == F.col("y_key")) & (F.col("x_rep") != F.col("y_rep")) & alike(near)
    return x.join(y, on).select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def links(sig: DataFrame, docs: DataFrame, near: Near = NEAR) -> tuple[DataFrame, DataFrame]:
    """Classes (h1, h2, n_shingles, rep) and components of class representatives (node, component)."""
    sets = sig.where("n_shingles > 0 and doc_id is not null")
    classes = materialise(
        sets.groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("doc_id", "bands", "p1", "p2", "p3", "p4")).alias("m"))
        .select("h1", "h2", "n_shingles", F.col("m.doc_id").alias("rep"), *(f"m.p{i}" for i in (1, 2, 3, 4)), "m.bands"), "classes")
    keyed = classes.select("rep", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    met = keyed.join(shared, "key")
    weight = met.groupBy("rep").agg(F.sum("met").alias("weight"))
    facts = classes.join(weight, "rep").select("rep", F.col("n_shingles").alias("n"), "p1", "p2", "p3", "p4", "weight")
    members = materialise(met.select("key", "rep").join(facts, "rep"), "members")

    chief = members.groupBy("key").agg(F.max(F.struct("weight", (-F.col("rep")).alias("least"), "rep", "n", "p1", "p2", "p3", "p4")).alias("m")).select("key", "m.*")
    first = materialise(_pairs(members, chief, near), "pairs")
    good = confirm(first, docs, near)
    parts = materialise(connected_components(good), "parts")

    # What the stars left apart: members of different components under one key.
    placed = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("part", F.coalesce("component", "rep")).drop("component")
    open_keys = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    rest = materialise(placed.join(open_keys, "key").select("rep", "n", "p1", "p2", "p3", "p4", "part").distinct(), "open")
    met = open_pairs(rest, docs, near)
    second = materialise(met.join(first, ["a", "b"], "left_anti"), "pairs")
    more = confirm(second, docs, near)
    comp = joined_components(parts, more)
    discard(members, first, good, rest, met, second)
    return classes.select("h1", "h2", "n_shingles", "rep"), comp


def near_duplicates(docs: DataFrame, near: Near = NEAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    sig = materialise(signatures(docs, near, ["doc_id"]), "signatures")
    classes, comp = links(sig, docs, near)
    found = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("h1", "h2", "n_shingles", F.coalesce("component", "rep").alias("found"))
    # Rows that share an id are one document: all take the least component of any.
    out = sig.select("doc_id", "n_shingles", "h1", "h2").join(found, ["h1", "h2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.least("found", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, near: Near = NEAR) -> DataFrame:
    """``docs`` with one document of each group, that of the least doc_id."""
    gone = near_duplicates(docs, near).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*(f"`{c}`" for c in docs.columns))


def near_sql(near: Near = NEAR) -> str:
    """``near_duplicates`` for DuckDB, over ``documents`` (doc_ids apart): all pairs of texts that share a
    shingle, and all that is reachable over links."""
    k = near.words
    return f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
        s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i + 1:i + {k}], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(0, greatest(1, len(ws) - {k - 1}))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM shared JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= {near.percent} * (x.n + y.n - c)),
        ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(node, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, ways.b FROM reach r JOIN ways ON r.other = ways.a)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, r.c = d.doc_id AS kept
        FROM documents d JOIN (SELECT node, min(other) AS c FROM reach GROUP BY node) r ON d.doc_id = r.node LEFT JOIN n ON d.doc_id = n.doc_id"""
