"""Substring dedup by paragraph MinHash banding.

Repeated passages stand anywhere in texts, so texts are cut by content, by the hashes of
three words in a row.  The same words are cut alike wherever they stand.

* Paragraphs: a text is cut where a hash is the least within ``reach`` places on both sides.
  Paragraphs do not overlap, cover the whole text and have 57 words on average; a text
  without a cut is one paragraph.  MinHash signatures of their five-word shingles in
  ``bands`` of ``rows`` slots give keys: at a similarity of 0.8 two paragraphs share one of
  six bands of three with probability 0.986.
* Windows: ``length`` words from each place that is least in some stretch of ``stretch``
  places.  Each run of length + stretch - 1 words holds a whole one, so every passage of
  over 50 words that occurs twice shows the same window twice.

Then:

* Paragraphs (windows) of equal words are one class, by a 128-bit fingerprint.
* Each key's classes are compared with its most frequent one (a star, not all pairs) by the
  exact Jaccard similarity of their shingles, made again from the texts.  Classes that stay
  in different components under one key meet again in an exact prefix join over their
  shingles, rarest first, so no link between classes that share a key is lost.
* Components of classes are the units of removal: of a unit that stands at two places or
  more, in one document or several, the earliest place stays and all others can go.

Between the steps intermediate tables are written; of hot passages only partial minima
are shuffled, and no pairs within a group of copies are made.

Defined results: null and empty texts and those of under five words have no paragraph; rows
that share a doc_id are one document (places that differ by less than a paragraph's words are
one place); rows without doc_id are left out; an empty table gives an empty table; further
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import chunks, discard, materialise, mix, ngram_hashes, roughly_in, word_stream
from tessera.llm.components import connected_components, joined_components


@dataclass(frozen=True)
class Passages:
    reach: int = 28
    length: int = 32
    stretch: int = 20
    words: int = 5
    percent: int = 80
    bands: int = 6
    rows: int = 3


#: Bits of a packed anchor that hold its place.
PLACE = np.uint64((1 << 28) - 1)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each ``w`` neighbours, by doubling."""
    if len(x) < w:
        return x[:0]
    k = 1
    while 2 * k <= w:
        x = np.minimum(x[:-k], x[k:])
        k *= 2
    return np.minimum(x[: len(x) - (w - k)], x[w - k :]) if k < w else x


def cuts(h: np.ndarray, sizes: np.ndarray, how: Passages) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts that stand one after the other as word hashes ``h``: starts and numbers of words
    of all paragraphs, and starts of all windows."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    of = np.repeat(np.arange(len(sizes)), sizes)
    g = ngram_hashes(h, 3)
    packed = (g & ~PLACE) | np.arange(len(g), dtype=np.uint64)  # equal hashes: the first counts
    wide = 2 * how.reach + 1
    least = sliding_min(packed, wide)
    i = np.flatnonzero(least == packed[how.reach : how.reach + len(least)])
    inside = of[i] == of[i + wide + 1]
    at = i[inside] + how.reach
    begins = np.sort(np.concatenate((starts[sizes >= how.words], at)))
    upto = np.append(begins[1:], len(h))
    words = np.minimum(upto, ends[of[begins]]) - begins if len(begins) else begins

    least = sliding_min(packed, how.stretch)
    i = np.arange(len(least))
    p = (least[of[i] == of[i + how.stretch + 1]] & PLACE).astype(np.int64)
    p = p[np.append(True, p[1:] != p[:-1])] if len(p) else p
    return begins, words, p[p + how.length <= ends[of[p]]] if len(p) else p


def _sums(x: np.ndarray, at: np.ndarray, n: np.ndarray, least: bool = False) -> np.ndarray:
    """The sum, or the least, of each stretch ``x[at : at + n]``."""
    bounds = np.stack((at, at + n), axis=1).reshape(-1)
    return (np.minimum if least else np.add).reduceat(np.append(x, np.uint64(0)), bounds)[::2]  # what begins at the end is never read


def fingerprints(h: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit fingerprints of each stretch of words ``h[at : at + n]``; stretches do not overlap."""
    place = np.zeros(len(h), np.uint64)
    place[at] = at
    place = np.arange(len(h), dtype=np.uint64) - np.maximum.accumulate(place)
    return [mix(_sums(mix((h ^ np.uint64(salt)) + place * np.uint64(0x9E3779B97F4A7C15)), at, n) + n.astype(np.uint64)) for salt in (0x2545F491, 0x6C62272E07BB0142)]


def window_fingerprints(s: np.ndarray, at: np.ndarray, n: int, step: int) -> list[np.ndarray]:
    """Two 64-bit fingerprints of the ``n`` words from each of ``at`` on, from shingle hashes ``s``."""
    out = [np.full(len(at), n, np.uint64), np.full(len(at), n * 7919, np.uint64)]
    for o in [*range(0, n - step, step), n - step]:
        x = s[at + o]
        out[0] = mix(out[0] + x)
        out[1] = mix(out[1] ^ (x * np.uint64(0x9E3779B97F4A7C15)))
    return out


def signatures(s: np.ndarray, at: np.ndarray, n: np.ndarray, how: Passages) -> np.ndarray:
    """Band keys (a row for each paragraph) of the shingles ``s[at : at + n - words + 1]``."""
    salts = mix(np.arange(1, how.bands * how.rows + 1, dtype=np.uint64)) | np.uint64(1)
    keys = np.empty((len(at), how.bands), np.uint64)
    for b in range(how.bands):
        key = np.full(len(at), b + 1, np.uint64)
        for r in range(how.rows):
            key = mix(key ^ _sums(mix(s * salts[b * how.rows + r]), at, n - how.words + 1, least=True))
        keys[:, b] = key
    return keys


def paragraphs(docs: DataFrame, how: Passages = Passages()) -> DataFrame:
    """(doc_id, pos, n, f1, f2, keys): place, words, fingerprint and band keys of each paragraph,
    and without keys of each window."""

    def run(batches):
        names = ["doc_id", "pos", "n", "f1", "f2", "keys"]
        for part, texts in chunks(batches, "text", 1 << 20):
            h, sizes = word_stream(texts)
            if len(h) < how.words:
                continue
            s = ngram_hashes(h, how.words)
            base, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)
            at, n, windows = cuts(h, sizes, how)
            doc_id = part.column(part.schema.get_field_index("doc_id"))

            def batch(at, n, prints, keys, of=of, base=base, doc_id=doc_id):
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1).view(np.int64)))
                columns = [doc_id.take(pa.array(of[at])), pa.array((at - base[of[at]]).astype(np.int32)), pa.array(n.astype(np.int32)), *(pa.array(f.view(np.int64)) for f in prints), lists]
                return pa.RecordBatch.from_arrays(columns, names=names)

            if len(at):
                yield batch(at, n, fingerprints(h, at, n), signatures(s, at, n, how))
            if len(windows):
                yield batch(windows, np.full(len(windows), how.length), window_fingerprints(s, windows, how.length, how.words), np.zeros((len(windows), 0), np.uint64))

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, pos int, n int, f1 long, f2 long, keys array<long>")


def _shingles(places: DataFrame, docs: DataFrame, how: Passages) -> DataFrame:
    """(id, set): the shingle hashes of paragraphs ``places`` (id, doc_id, pos, n, f1, f2).  Of rows
    that share a doc_id only one whose words have the fingerprint counts."""
    asked = places.groupBy("doc_id").agg(F.collect_list(F.struct("id", "pos", "n", "f1", "f2")).alias("asked"))  # of one document
    both = roughly_in(docs.select("doc_id", "text"), "doc_id", places.select("doc_id")).join(asked, "doc_id")

    def run(batches):
        for part, texts in chunks(batches, "text"):
            h, sizes = word_stream(texts)
            asked = part.column(part.schema.get_field_index("asked"))
            x = asked.flatten()
            column = lambda c: x.field(c).to_numpy(zero_copy_only=False)
            of = np.repeat(np.arange(len(sizes)), pa.compute.list_value_length(asked).to_numpy(zero_copy_only=False))
            at, n = (np.cumsum(sizes) - sizes)[of] + column("pos"), column("n").astype(np.int64)
            fits = column("pos") + n <= sizes[of]
            ids, f1, f2, at, n = (c[fits] for c in (column("id"), column("f1"), column("f2"), at, n))
            same = np.zeros(len(at), bool)
            if len(at):
                order = np.argsort(at)  # paragraphs of a text do not overlap
                prints = [f.view(np.int64) for f in fingerprints(h, at[order], n[order])]
                same[order] = (prints[0] == f1[order]) & (prints[1] == f2[order])
            s = ngram_hashes(h, how.words)
            sets = [np.unique(s[a : a + k - how.words + 1]) for a, k in zip(at[same], n[same], strict=True)]
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[same]), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))], names=["id", "set"])

    return both.select("text", "asked").mapInArrow(run, "id long, set array<long>").dropDuplicates(["id"])


def _verified(pairs: DataFrame, sets: DataFrame, how: Passages) -> DataFrame:
    """The pairs (a, b) of classes whose shingles are similar enough."""
    sides = [sets.select(F.col("id").alias(n), F.col("set").alias(s)) for n, s in (("a", "x"), ("b", "y"))]
    both = pairs.join(sides[0], "a").join(sides[1], "b").where(100 * F.least(F.size("x"), F.size("y")) >= how.percent * F.greatest(F.size("x"), F.size("y")))
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= how.percent * (F.size("x") + F.size("y") - common)).select("a", "b")


def _open_pairs(members: DataFrame, how: Passages) -> DataFrame:
    """(a, b): pairs of ``members`` (id, set, part) of different parts that may be links.

    Sets are ordered by how few members have a shingle, so paragraphs that each have edits of
    their own do not meet; what stands behind a shared shingle bounds the intersection.
    """
    each = members.select("id", "part", F.size("set").alias("n"), F.explode("set").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("held"), F.min("part").alias("lo"), F.max("part").alias("hi"))
    place = F.row_number().over(Window.partitionBy("id").orderBy("held", "shingle")) - 1
    head = each.join(held, "shingle").withColumn("i", place).where("lo <> hi").where(100 * (F.col("n") - F.col("i")) >= how.percent * F.col("n"))
    head = materialise(head.select("shingle", "id", "part", "n", "i"), "heads")
    x, y = (head.select("shingle", *(F.col(c).alias(f"{side}_{c}") for c in ("id", "part", "n", "i"))) for side in "xy")
    behind = F.least(F.col("x_n") - F.col("x_i"), F.col("y_n") - F.col("y_i"))
    enough = 100 * behind >= how.percent * (F.col("x_n") + F.col("y_n") - behind)
    both = x.join(y, "shingle").where((F.col("x_part") < F.col("y_part")) & enough)
    out = materialise(both.select(F.least("x_id", "y_id").alias("a"), F.greatest("x_id", "y_id").alias("b")).distinct(), "pairs")
    discard(head)
    return out


def similar_classes(windows: DataFrame, docs: DataFrame, how: Passages) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes of paragraphs (id, held: how many, doc_id, pos, n: the earliest, f1, f2, keys), verified
    links (a, b) of their ids, enough of them to connect all that any links between classes of one
    key connect, and their components (node, component)."""
    paras = windows.where(F.size("keys") > 0).groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "pos", "n", "keys")).alias("p"), F.count(F.lit(1)).alias("held"))
    classes = materialise(paras.select(F.monotonically_increasing_id().alias("id"), "held", "p.*", "f1", "f2"), "classes")
    keys = classes.select(F.explode("keys").alias("key"), "id", "held")
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("met")).where("met > 1").select("key")
    members = materialise(keys.join(met, "key"), "members")
    sets = materialise(_shingles(classes.join(members.select("id").distinct(), "id"), docs, how), "sets")
    lead = members.groupBy("key").agg(F.max("held").alias("held")).join(members, ["key", "held"]).groupBy("key").agg(F.min("id").alias("lead"))
    first = materialise(members.join(lead, "key").where("id <> lead").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct(), "pairs")
    good = materialise(_verified(first, sets, how), "links")

    # What the stars left apart: classes of different components under one key.
    parts = materialise(connected_components(good), "parts")
    placed = members.select("key", "id").join(parts.withColumnRenamed("node", "id"), "id", "left").select("key", "id", F.coalesce("component", "id").alias("part"))
    still = placed.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("key")
    rest = materialise(sets.join(placed.join(still, "key").select("id", "part").distinct(), "id"), "open")
    second = _open_pairs(rest, how)
    more = materialise(_verified(second.join(first, ["a", "b"], "left_anti"), sets, how), "links")
    discard(members, sets, first, rest, second)
    return classes, good.unionByName(more), joined_components(parts, more)


def _units(windows: DataFrame, docs: DataFrame, how: Passages) -> DataFrame:
    """(doc_id, pos, n, wide, u1, u2): places of paragraphs (wide) and windows whose unit, the class or
    its component's first class, may stand at several places."""
    classes, _, comp = similar_classes(windows, docs, how)
    name = classes.select("id", "f1", "f2")
    heads = name.select(F.col("id").alias("component"), F.col("f1").alias("u1"), F.col("f2").alias("u2"))
    renamed = materialise(comp.withColumnRenamed("node", "id").join(name, "id").join(heads, "component").select("f1", "f2", "u1", "u2"), "renamed")
    discard(classes)
    wide = (F.size("keys") > 0).alias("wide")
    slim = windows.select("doc_id", "pos", "n", wide, "f1", "f2")
    # Most words stand once in the corpus: only those that repeat or resemble others go on.
    again = slim.groupBy("f1").agg(F.count(F.lit(1)).alias("held")).where("held > 1").select("f1")
    asked = materialise(again.unionByName(renamed.select("f1")).distinct(), "asked")
    some = roughly_in(slim, "f1", asked).join(asked, "f1").join(renamed.withColumn("wide", F.lit(True)), ["f1", "f2", "wide"], "left")
    out = materialise(some.select("doc_id", "pos", "n", "wide", F.coalesce("u1", "f1").alias("u1"), F.coalesce("u2", "f2").alias("u2")), "units")
    discard(renamed, asked)
    return out


def repeated_passages(docs: DataFrame, how: Passages = Passages()) -> DataFrame:
    """One row for each document with passages that stand elsewhere too: (doc_id, n_paragraphs,
    n_removed, spans, removed, first_docs).  Spans are merged stretches of words [start, end);
    ``removed`` are those that stand earlier already, ``first_docs`` where these do."""
    windows = materialise(paragraphs(docs, how), "paragraphs")
    places = _units(windows, docs, how)
    discard(windows)
    unit, place = ["wide", "u1", "u2"], F.struct("doc_id", "pos", "n")
    ends = places.groupBy(*unit).agg(F.min(place).alias("first"), F.max(place).alias("last"))
    apart = lambda doc, pos: (doc != F.col("first.doc_id")) | (pos - F.col("first.pos") >= F.col("first.n"))
    # Written apart, so that the join below deals out places by itself and a hot unit can be split.
    first = materialise(ends.where(apart(F.col("last.doc_id"), F.col("last.pos"))).select(*unit, "first"), "first")
    hits = places.join(first, unit).select("doc_id", "pos", (F.col("pos") + F.col("n")).alias("end"), apart(F.col("doc_id"), F.col("pos")).alias("goes"), F.col("first.doc_id").alias("first_doc"))
    hits = materialise(hits, "hits")
    discard(places, first)

    # Stretches of a document begin where no earlier place reaches: of all places (k), and of those that go (g).
    order = Window.partitionBy("doc_id").orderBy("pos", "end")
    past, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    new = F.when(F.col("pos") <= F.max("end").over(past), 0).otherwise(1)
    new_gone = F.when(F.col("goes"), F.when(F.col("pos") <= F.max(F.when(F.col("goes"), F.col("end"))).over(past), 0).otherwise(1)).otherwise(0)
    marked = hits.withColumn("new", new).withColumn("new_gone", new_gone).withColumn("k", F.sum("new").over(upto)).withColumn("g", F.sum("new_gone").over(upto))
    gone = lambda f, c: f(F.when(F.col("goes"), F.col(c)))
    parts = materialise(marked.groupBy("doc_id", "k", "g").agg(F.min("pos").alias("a"), F.max("end").alias("z"), gone(F.min, "pos").alias("ga"), gone(F.max, "end").alias("gz"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("goes"), 1)).alias("n_gone")), "parts")
    merged = lambda by, a, z: parts.groupBy("doc_id", by).agg(F.min(a).alias("a"), F.max(z).alias("z"), F.sum("n").alias("n"), F.sum("n_gone").alias("n_gone"))
    text = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "z")))), lambda x: F.concat_ws("-", x["a"].cast("string"), x["z"].cast("string"))), ",")
    whole = merged("k", "a", "z").groupBy("doc_id").agg(F.sum("n").alias("n_paragraphs"), F.sum("n_gone").alias("n_removed"), text("a").alias("spans"))
    sources = hits.select("doc_id", "first_doc").distinct().groupBy("doc_id").agg(F.array_sort(F.collect_list("first_doc")).alias("first_docs"))
    goes = merged("g", "ga", "gz").groupBy("doc_id").agg(text("ga").alias("removed"))
    return whole.join(goes, "doc_id").join(sources, "doc_id").select("doc_id", "n_paragraphs", "n_removed", "spans", "removed", "first_docs")
