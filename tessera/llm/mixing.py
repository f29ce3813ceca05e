"""Mixing sources to target weights by a low-discrepancy schedule.

* Sources weigh 1, 2, 3, repeating, in code point order.  They share the whole corpus's
  words by weight; a target stops at ``most`` times its source's size and the excess is
  shared again by weight until no target is above its bound.
* Slot i of the schedule has the van der Corput point of i, which falls into one source's
  interval of the cumulative target shares.  How many earlier slots fell there, the slot's
  rank, has a closed form: among the first i points those below x are counted by the dyadic
  blocks that make up i.  So no window or sort over slots is needed, and every source's
  slots are spread evenly over the schedule.
* A source's documents are laid end to end in an order shuffled by hash, read again from the
  start when used up.  Its slots cut its target into equal blocks of words, and rank r
  takes block r.  A document's words in all blocks are what the mix takes of it.

Positions in a source's stream are prefix sums in two levels: sums inside buckets of the
hash order, and over the buckets' totals.  Buckets are about as many as the square root of
the documents, so a source with a third of all rows is spread over many tasks and no task
orders more than that many totals.

Defined results: texts without words have size 0 and take 0 words; a null source is one
source, the last; rows that share id and text share their place in the order by
their text's hash and are taken as one after the other; an empty table gives an empty
table; if no document has words all targets are 0; further columns are ignored, but kept by
``mixed_corpus``.  One row a source comes to the driver, which makes the schedule's plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import free_name, materialise, word_array


@dataclass(frozen=True)
class Mix:
    """Weights by source order, the bound on repeats, words in a slot (about), and the shuffle's seed."""

    weights: tuple[int, ...] = (1, 2, 3)
    most: int = 3
    slot: int = 1024
    seed: int = 17


#: Points of the schedule are dyadic fractions of this many bits.
BITS = 40


def targets(sizes: list[int], weights: list[int], most: int) -> list[Fraction]:
    """Shares of the total by weight under the bound of ``most`` times each size (exact)."""
    left = Fraction(sum(sizes))
    out: list[Fraction | None] = [None] * len(sizes)
    while open_ := [i for i, t in enumerate(out) if t is None]:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= most * sizes[i]]
        for i in full or open_:
            out[i] = Fraction(most * sizes[i]) if full else left * weights[i] / total
        left -= sum(out[i] for i in full or ())
    return out


def below(n: str, x: str) -> Column:
    """How many of the first ``n`` van der Corput points are below ``x`` (names of long columns).

    From the highest bit of n down: a block of 2**k indices has the points of its first
    index plus the multiples of 2**-k; p is that first point, in units of 2**-BITS.
    """
    bit = f"(shiftright({n}, {BITS - 1} - j) & 1L) = 1L"
    return F.expr(
        f"aggregate(sequence(0, {BITS - 1}), named_struct('c', 0L, 'p', 0L), (s, j) -> named_struct("
        f"'c', s.c + if({bit}, shiftright({x}, j + 1) + if(({x} & (shiftleft(1L, j + 1) - 1L)) > s.p, 1L, 0L), 0L), "
        f"'p', s.p + if({bit}, shiftleft(1L, j), 0L)), s -> s.c)")  # fmt: skip


def count_below(n: int, x: int) -> int:
    """``below`` for plain numbers."""
    count = point = 0
    for j in range(BITS):
        k = BITS - 1 - j
        if n >> k & 1:
            # 2**k indices whose points are point + i * 2**-k: their units are i << (BITS - k)
            count += (x >> (j + 1)) + ((x & ((1 << (j + 1)) - 1)) > point)
            point += 1 << j
    return count


def plan(spark, by_source: list[tuple[str | None, int]], mix: Mix) -> tuple[DataFrame, int]:
    """One row for each source (source, source_size, target, slots, lo, hi in units of
    2**-BITS) and the number of slots of the schedule."""
    names = sorted((s for s, _ in by_source if s is not None), key=lambda s: s.encode()) + [None] * any(s is None for s, _ in by_source)
    size = dict(by_source)
    weights = [mix.weights[i % len(mix.weights)] for i in range(len(names))]
    want = targets([size[s] for s in names], weights, mix.most)
    total = sum(want)
    n = max(1, math.ceil(total / mix.slot), 64 * len(names)) if total else 0
    rows, upto = [], Fraction(0)
    for s, t in zip(names, want, strict=True):
        lo = int(upto / total * (1 << BITS)) if total else 0
        upto += t
        hi = int(upto / total * (1 << BITS)) if total else 0
        words, slots = int(t), count_below(n, hi) - count_below(n, lo)
        block = max(1, -(-words // max(1, slots)))  # words in each block; the last may have fewer
        rows.append((s, size[s], float(t), words, slots, block, -(-words // block), lo, hi))
    return spark.createDataFrame(rows, "source string, source_size long, target double, words long, slots long, block long, blocks long, lo long, hi long"), n


#: Sources up to which their table goes to every task; its rows are these and the cells' number at most.
FEW = 20_000


def schedule(sources: DataFrame, n: int, few: bool) -> DataFrame:
    """(slot, source, rank): which block of which source each slot takes.

    A source so small that no point falls on it has one slot after all others.  Points find
    their source through the cells of the unit interval that its stretch touches; where the
    sources are ``few`` their slots are ranked where they are made, otherwise after being dealt
    out by slot.
    """
    cell = BITS - 12
    stretches = sources.where("slots > 0").select("source", "lo", "hi", "blocks", F.explode(F.sequence(F.shiftright("lo", cell), F.shiftright(F.col("hi") - 1, cell))).alias("cell"))
    spark = sources.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-n // 200_000))
    slots = spark.range(0, n, 1, parts).withColumnRenamed("id", "slot").withColumn("point", _point(F.col("slot"))).withColumn("cell", F.shiftright("point", cell))
    hit = slots.join(F.broadcast(stretches) if few else stretches, "cell").where("point >= lo and point < hi")
    hit = hit if few else hit.repartition(parts, "slot")
    ranked = hit.select("slot", "source", (below("slot", "hi") - below("slot", "lo")).alias("rank"), "blocks").where("rank < blocks").drop("blocks")
    late = sources.where("slots = 0 and blocks > 0").select(F.lit(n).cast("long").alias("slot"), "source", F.lit(0).cast("long").alias("rank"))
    return ranked.unionByName(late)


def _point(i: Column) -> Column:
    """The van der Corput point of i in units of 2**-BITS: its BITS lowest bits in reverse."""
    return F.conv(F.reverse(F.lpad(F.bin(i), BITS, "0")), 2, 10).cast("long")


def sizes(docs: DataFrame, mix: Mix, *keep: str) -> DataFrame:
    """doc_id, source, size, and the shuffled place (key, tie) of every row, with its ``keep`` columns."""
    words = word_array(F.col("text"))
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.size(words).cast("long").alias("size"), F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(mix.seed)).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"), *keep)


def mixture(docs: DataFrame, mix: Mix = Mix(), row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The documents (row, doc_id, source, size, source_size, target) and the mix itself:
    (slot, source, rank, row, doc_id, from_word, to_word), each piece a stretch of a
    document's words that the slot takes, to be read in the order of slots and positions.
    ``row``: a column of ``docs`` that tells its rows apart, if it has one already."""
    spark = docs.sparkSession
    if row is None:
        rows = materialise(sizes(docs, mix).withColumn("row", F.monotonically_increasing_id()), "sizes")
    else:
        rows = materialise(sizes(docs, mix, row).withColumnRenamed(row, "row"), "sizes")
    per = rows.groupBy("source").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("docs")).collect()  # one row a source
    bits = max(3, math.ceil(math.log2(max(1, sum(r["docs"] for r in per))) / 2))
    sources, n = plan(spark, [(r["source"], r["n"]) for r in per], mix)
    sources = sources.withColumn("s", F.xxhash64("source"))  # of a null source too, so plain joins find it

    placed = rows.withColumn("s", F.xxhash64("source")).withColumn("bucket", F.shiftrightunsigned("key", 64 - bits))
    sums = placed.groupBy("s", "bucket").agg(F.sum("size").alias("held"))
    over = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("s", "bucket", F.coalesce(F.sum("held").over(over), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "bucket").orderBy("key", "doc_id", "tie", "row").rowsBetween(Window.unboundedPreceding, -1)
    stream = placed.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(starts, ["s", "bucket"])
    facts = sources.select("s", "source_size", "target", "words", "block")
    stream = stream.select("row", "doc_id", "source", "s", "size", (F.col("base") + F.col("offset")).alias("start")).join(facts, "s")

    # A document stands at start, and again one source size further for every new reading.
    again = F.explode(F.expr("sequence(0L, (words - start - 1) div source_size)")).alias("reading")
    read = stream.where("size > 0 and start < words").select("*", again).withColumn("a", F.expr("reading * source_size + start")).withColumn("b", F.expr("least(a + size, words)"))
    pieces = read.select("row", "doc_id", "s", "block", "a", "b", F.explode(F.expr("sequence(a div block, (b - 1) div block)")).alias("rank"))
    slots = schedule(sources, n, len(per) <= FEW).withColumn("s", F.xxhash64("source"))
    first = F.expr("greatest(0L, rank * block - a)")
    mixed = pieces.join(slots, ["s", "rank"]).select("slot", "source", "rank", "row", "doc_id", first.alias("from_word"), F.expr("least(b, (rank + 1) * block) - a").alias("to_word"))
    return stream.select("row", "doc_id", "source", "size", "source_size", "target"), mixed


def mix_documents(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for every row of ``docs``."""
    rows, mixed = mixture(docs, mix)
    taken = mixed.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("got"))
    return rows.join(taken, "row", "left").select("doc_id", "size", "source", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"))


#: Columns that ``mixed_corpus`` adds.
ADDED = ("size", "source_size", "target", "taken", "slots")


def mixed_corpus(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The rows of ``docs`` of which the mix takes words, with all their columns and ADDED: words of the
    row and of its source, the source's target, words taken, and ``slots``, a list of (slot,
    from_word, to_word) by slot.  Read in the order of slots, these stretches are the mix: a
    consumer that sorts or ranges by the first slot gets every prefix in the target proportions.
    """
    row = free_name([*docs.columns, "doc_id", "source", "size", "key", "tie"], "row_")
    own = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    rows, mixed = mixture(own, mix, row)
    pieces = mixed.groupBy("row").agg(F.sum(F.col("to_word") - F.col("from_word")).cast("long").alias("taken"), F.array_sort(F.collect_list(F.struct("slot", "from_word", "to_word"))).alias("slots"))
    facts = rows.select("row", "size", "source_size", "target").join(pieces, "row")
    names = {c: free_name(docs.columns, c) for c in ADDED}
    facts = facts.select(F.col("row").alias(row), *(F.col(c).alias(names[c]) for c in ADDED))
    return own.join(facts, row).select(*(f"`{c}`" for c in docs.columns), *names.values())
