"""Benchmark decontamination by latent semantic retrieval.

* Texts become word numbers once: words of the benchmark have their own, all others hash
  buckets.  The same pass counts in how many texts each occurs (TF-IDF).
* A randomised SVD of the TF-IDF passages of the benchmark and of all documents, cut into windows
  one after the other, (both with the same weight in all), with products summed over partitions
  and blocks of features (of up to 8191 features: sums of all pairs, made once and multiplied), gives the latent space: words that occur together in the corpus come
  to lie together, whether the benchmark has them or not.  Items of more than two windows are
  cut into passages of a window, overlapping by half.
* Every document is cut into windows of ``window`` words that overlap by half.  Each window, with
  all its words, is folded into the latent space and compared with all benchmark passages.
  Candidates have a cosine (by the window's whole TF-IDF norm) from ``cosine`` on, or hold
  ``held`` of what a window can hold of the passage, whatever else stands in the window: so
  passages of common words are found among rare ones.
* Candidates are checked on words: the heaviest common subsequence of the item and the
  text around, by inverse document frequency, must carry ``strong`` of the item's weight, or
  ``weak`` of it when the item's answer (what follows its last full stop or line break
  inside) is there too.
* Items of fewer than ``least`` words are too short to be told from chance in running text; they
  are looked up by a hash of their words among all lines and whole texts.

Texts are read once, their word numbers twice (pairs and search; four times with more features, for three
products and the search), and never shuffled.  An index holds up
to ``items`` items, which bounds what is collected and broadcast; a larger benchmark is
searched by several, one after the other.

Defined results: null or empty texts and items hold nothing; rows are judged one by one, so
repeated rows give repeated hits only once for a doc_id; a null doc_id is reported as null;
empty tables give an empty table; further columns pass through ``drop_leaks``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import byte_hashes, chunks, cleaning, discard, free_name, lean, materialise, mix, word_bounds


@dataclass(frozen=True)
class Leaks:
    window: int = 32
    dims: int = 192
    over: int = 16
    buckets: int = 4096
    features: int = 16384
    cosine: float = 0.3
    held: float = 0.3
    strong: float = 0.7
    weak: float = 0.55
    least: int = 8
    items: int = 20_000


EDGES = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_EDGE = np.zeros(256, bool)
_EDGE[list(EDGES)] = True


def folded(raw: bytes) -> bytes:
    return raw.lower() if raw.isascii() else raw.decode("utf-8", "replace").lower().encode()


def words_of(raw: bytes) -> list[bytes]:
    """Lower-case words without punctuation at their ends."""
    return [x for w in folded(raw).split() if (x := w.strip(EDGES))]


def answer_words(raw: bytes) -> int:
    """How many words at the end of an item are its answer: those after its last inner full stop or line break."""
    parts = [p for p in re.split(rb"[.!?\n]+(?=\s|$)|\n", raw) if words_of(p)]
    return len(words_of(parts[-1])) if len(parts) > 1 else 0


def hashed(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the ``words_of`` all texts, how many each text has, and each word's line (texts begin lines)."""
    low = [folded(raw) for raw in texts]
    data = np.frombuffer(b"\n".join(low), np.uint8)
    at, starts, lens = word_bounds(data)
    if not len(lens):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
    heads, k = np.cumsum(lens) - lens, np.arange(len(at))
    inner = ~_EDGE[data[at]]
    first = np.minimum.reduceat(np.where(inner, k, len(at)), heads)
    last = np.maximum.reduceat(np.where(inner, k, -1), heads)
    whole = first <= last
    within = (k >= np.repeat(first, lens)) & (k <= np.repeat(last, lens))
    starts = starts[whole]
    upto = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)) + 1)
    lines = np.searchsorted(np.flatnonzero(data == 10), starts)
    return byte_hashes(data, at[within], (last - first + 1)[whole]), np.diff(np.searchsorted(starts, upto), prepend=0), lines


def numbered(h: np.ndarray, vocabulary: np.ndarray, buckets: int) -> np.ndarray:
    """Numbers of word hashes: places in the (sorted) vocabulary, then buckets of all others."""
    at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
    other = len(vocabulary) + (h % np.uint64(buckets)).astype(np.int64)
    return np.where(vocabulary[at] == h, at, other) if len(vocabulary) else other


def in_row(h: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Hashes of the stretches of words that begin at ``heads``."""
    place = np.arange(len(h), dtype=np.uint64) - np.repeat(heads, np.diff(np.append(heads, len(h)))).astype(np.uint64)
    return np.add.reduceat(mix(h + place * np.uint64(0x9E3779B97F4A7C15)), heads) if len(heads) else np.zeros(0, np.uint64)


DOCUMENT, COUNT, SHORT = range(3)


def coded(docs: DataFrame, vocabulary: np.ndarray, short: list[np.ndarray], how: Leaks) -> DataFrame:
    """A table of (kind, doc_id, ids, f, n): of each text its word numbers and how many (n); in how many
    texts (n) a number (f) occurs, by partition; and which (f) of the ``short`` items, as word
    hashes, is a line of the text or all of it."""
    size = len(vocabulary) + how.buckets
    word = np.uint16 if size <= 1 << 16 else np.uint32
    shorts = {}
    for i, x in enumerate(short):
        shorts.setdefault(int(in_row(x, np.zeros(1, np.int64))[0]), []).append(i)
    known = np.array(sorted(shorts), np.uint64)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["kind", "doc_id", "ids", "f", "n"]

    def run(batches):
        total = np.zeros(size + 1, np.int64)
        mark = np.zeros(size, np.int64)
        kind_of_id = None

        def rows(kind, doc_id, ids, f, n):
            m = len(f)
            return pa.RecordBatch.from_arrays([pa.array(np.full(m, kind, np.int8)), doc_id if doc_id is not None else pa.nulls(m, kind_of_id), ids if ids is not None else pa.nulls(m, pa.binary()), pa.array(f, pa.int64()), pa.array(n, pa.int64())], names=names)

        for part, texts in chunks(batches, "text", 1 << 20):
            doc_id = part.column(part.schema.get_field_index("doc_id"))
            kind_of_id = doc_id.type
            h, sizes, lines = hashed(texts)
            ends = np.cumsum(sizes)
            ids = numbered(h, vocabulary, how.buckets)
            small = ids.astype(word)
            raw, wide = small.tobytes(), small.itemsize
            cells = [raw[(e - n) * wide : e * wide] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
            total[-1] += len(texts)
            for e, n in zip(ends.tolist(), sizes.tolist(), strict=True):
                own = ids[e - n : e]
                turn = np.arange(n)
                mark[own] = turn  # of equal numbers the last place stays, so each counts once
                total[own[mark[own] == turn]] += 1
            yield rows(DOCUMENT, doc_id, pa.array(cells, pa.binary()), np.zeros(len(cells), np.int64), sizes)
            if len(known) and len(h):
                of = np.repeat(np.arange(len(sizes)), sizes)
                found = set()
                for group in (lines, of):
                    heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
                    stops = np.append(heads[1:], len(h))
                    for k in np.flatnonzero(np.isin(in_row(h, heads), known)):
                        a, z = heads[k], stops[k]
                        found |= {(int(of[a]), i) for i in shorts[int(in_row(h[a:z], np.zeros(1, np.int64))[0])] if np.array_equal(short[i], h[a:z])}
                if found:
                    which = sorted(found)
                    yield rows(SHORT, doc_id.take(pa.array([d for d, _ in which])), None, np.array([i for _, i in which]), np.zeros(len(which), np.int64))
        some = np.flatnonzero(total)
        if len(some) and kind_of_id is not None:
            yield rows(COUNT, None, None, some, total[some])

    return materialise(docs.select("doc_id", "text").mapInArrow(lean(run), f"kind byte, doc_id {id_type}, ids binary, f long, n long"), "coded")


def frequencies(table: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many texts each number occurs, and how many texts there are."""
    out = np.zeros(size + 1, np.int64)
    for r in table.where(F.col("kind") == COUNT).groupBy("f").agg(F.sum("n").alias("n")).collect():  # a row a number
        out[r["f"]] = r["n"]
    return out[:-1], int(out[-1])


#: Features whose sums travel as one value, and about how many words of the passages each part sums.
SLAB, PART_WORDS = 512, 4 << 20
#: Numbers (the most frequent) whose sums are products of small dense matrices, windows handled at
#: once, and bytes of word numbers whose sums are in single precision.
HOT, STEP, BLOCK = 256, 512, 1 << 19
#: Up to so many pairs of columns (8191 columns) the sums of all pairs are stored once, otherwise each product
#: reads the passages; pairs that travel as one value, pairs (of the most frequent columns) summed in double
#: precision, and about how many words of the passages each part takes.
PAIRS, PAIR_SLAB, HOT_PAIRS, PAIR_WORDS = 1 << 25, 1 << 16, 512 * 513 // 2, 12 << 20


def _added(parts: pa.Table) -> pa.Table:
    """The sum of one slab's arrays, in double precision and in the order of their parts, one after the other."""
    parts, total = parts.sort_by("part"), 0.0
    for x in parts.column("sums"):
        total = total + np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
    return pa.table([parts.column("slab").slice(0, 1), pa.array([total.astype(np.float32).tobytes()], pa.binary())], names=["slab", "sums"])


def _product(passages: DataFrame, rows: int, width: int, make) -> np.ndarray:
    """The sum over partitions of arrays (rows x width), added on executors slab by slab (in double
    precision; single precision travels)."""

    def run(batches):
        from pyspark import TaskContext

        total = make(batches)
        slabs = range(0, rows, SLAB)
        yield pa.RecordBatch.from_arrays([pa.array([a // SLAB for a in slabs], pa.int32()), pa.array([TaskContext.get().partitionId()] * len(slabs), pa.int32()), pa.array([total[a : a + SLAB].astype(np.float32).tobytes() for a in slabs], pa.binary())], names=["slab", "part", "sums"])

    got = passages.mapInArrow(lean(run), "slab int, part int, sums binary").groupBy("slab").applyInArrow(_added, "slab int, sums binary")
    out = np.zeros((rows, width))
    with cleaning(passages.sparkSession):
        slabs = got.collect()  # the model itself: features x dimensions
    for r in slabs:
        a = r["slab"] * SLAB
        out[a : a + SLAB] = np.frombuffer(r["sums"], np.float32).reshape(-1, width)
    return out


def _add_windows(block: np.ndarray, flat: np.ndarray, sizes: np.ndarray, scales: np.ndarray, cut: int, rows: np.ndarray, weights: np.ndarray, hot: np.ndarray, often: np.ndarray) -> None:
    """Adds to the row (of ``block``) of every word number, for each of its places in windows of ``cut`` words
    of the texts, the window's sum of ``rows`` times (scale / norm)**2."""
    counts = -(-sizes // cut)
    if not counts.sum():
        return
    sums = _half_sums(flat, sizes, rows, cut)
    text = np.repeat(np.arange(len(sizes)), counts)
    place = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = (np.cumsum(sizes) - sizes)[text] + place * cut
    sums *= (scales[text] ** 2 / np.add.reduceat(weights[flat].astype(np.float64) ** 2, starts)).astype(np.float32)[:, None]
    ends = np.append(starts[1:], len(flat))
    for a in range(0, len(sums), STEP):  # in pieces that stay in the processor's cache
        z = min(a + STEP, len(sums))
        some, ids = sums[a:z], flat[starts[a] : ends[z - 1]]
        of = np.repeat(np.arange(z - a), ends[a:z] - starts[a:z])
        frequent = hot[ids] >= 0
        times = np.bincount(hot[ids[frequent]] * len(some) + of[frequent], minlength=len(often) * len(some))
        block[often] += times.reshape(len(often), -1).astype(np.float32) @ some
        # Of all others first places of every number, then second ones, and so on: no number twice at once.
        ids, of = ids[~frequent], of[~frequent]
        order = np.argsort(ids, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(ids[order]) != 0)[: len(ids)])
        turn = np.arange(len(ids)) - np.repeat(heads, np.diff(np.append(heads, len(ids))))
        order, upto = order[np.argsort(turn, kind="stable")], np.cumsum(np.bincount(turn))
        for x, y in zip(np.append(0, upto[:-1]), upto, strict=False):
            block[ids[order[x:y]]] += some[of[order[x:y]]]


def _add_pairs(pairs: np.ndarray, flat: np.ndarray, values: np.ndarray, sizes: np.ndarray, cut: int) -> None:
    """Adds to ``pairs`` (of places, the larger one's row first) the products of ``values`` of all two words of each
    window of ``cut`` words, over the window's norm squared, and half the square of each word."""
    counts = -(-sizes // cut)
    starts = np.repeat(np.cumsum(sizes) - sizes, counts) + cut * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    if not len(starts):
        return
    lens = np.diff(np.append(starts, len(flat)))
    norms = np.sqrt(np.add.reduceat(values[0].astype(np.float64) ** 2, starts))
    scaled = values[1] / np.repeat(norms, lens).astype(np.float32)
    turn = np.arange(cut)[:, None]
    for a in range(0, len(starts), 2 * STEP):  # in pieces that stay in the processor's cache
        within = turn < lens[a : a + 2 * STEP]
        at = np.where(within, starts[a : a + 2 * STEP] + turn, 0)
        place, value = np.where(within, flat[at], 0), np.where(within, scaled[at], np.float32(0))
        order = np.argsort(place, axis=0)
        place, value = np.take_along_axis(place, order, 0), np.take_along_axis(value, order, 0)
        row = place * (place + 1) // 2
        np.add.at(pairs, (row + place).ravel(), (value * value / 2).ravel())
        for k in range(1, cut):
            np.add.at(pairs, (row[k:] + place[:-k]).ravel(), (value[k:] * value[:-k]).ravel())


def _pair_sums(passages: DataFrame, size: int, places: np.ndarray, weights: np.ndarray, word) -> tuple[DataFrame, np.ndarray]:
    """P, with A^T A = P + P^T, as a table (slab, sums) of its rows (up to the diagonal) by ``places`` of columns,
    and the slabs' first rows.  ``places``: of every number, the most frequent first."""
    sc = passages.sparkSession.sparkContext
    ends = np.arange(size + 1, dtype=np.int64) * np.arange(1, size + 2) // 2
    first = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], PAIR_SLAB)), size))
    shared = sc.broadcast((places, weights))

    def run(batches):
        from pyspark import TaskContext

        places, weights = shared.value
        pairs, hot = np.zeros(ends[-1], np.float32), np.zeros(min(HOT_PAIRS, ends[-1]))
        for part, cells in chunks(batches, "ids", BLOCK):
            scales, cuts = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("scale", "cut"))
            sizes = np.fromiter(map(len, cells), np.int64, len(cells)) // np.dtype(word).itemsize
            flat = np.frombuffer(b"".join(cells), word).astype(np.int64)
            of = np.repeat(np.arange(len(cells)), sizes)
            for cut in np.unique(cuts):
                mine = cuts == cut
                ids = flat[mine[of]]
                _add_pairs(pairs, places[ids], (weights[ids], weights[ids] * np.repeat(scales[mine], sizes[mine]).astype(np.float32)), sizes[mine], int(cut))
            hot += pairs[: len(hot)]
            pairs[: len(hot)] = 0
        pairs[: len(hot)] = hot
        for a in range(0, len(first) - 1, 32):
            some = range(a, min(a + 32, len(first) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(some), pa.int32()), pa.array([pairs[ends[first[i]] : ends[first[i + 1]]].tobytes() for i in some], pa.binary())], names=["slab", "part", "sums"])

    out = materialise(passages.mapInArrow(lean(run), "slab int, part int, sums binary").groupBy("slab").applyInArrow(_added, "slab int, sums binary"), "pairs")
    shared.destroy()
    return out, first


def latent(passages: DataFrame, size: int, columns: np.ndarray, weights: np.ndarray, word, how: Leaks) -> np.ndarray:
    """V: the latent directions (features x dims) of the TF-IDF matrix of the ``passages`` (ids, scale, cut),
    each in windows of ``cut`` words."""
    sc = passages.sparkSession.sparkContext
    width = min(how.dims + how.over, size)

    hot = np.full(len(weights), -1)
    often = np.argsort(weights, kind="stable")[:HOT]
    hot[often] = np.arange(len(often))
    step = size if len(columns) == size else size - how.buckets  # so many numbers in a row have a column each
    pairs = None
    if size * (size + 1) // 2 <= PAIRS:
        lightest = np.full(size, np.inf)
        np.minimum.at(lightest, columns, weights)
        place = np.empty(size, np.int64)
        place[np.argsort(lightest, kind="stable")] = np.arange(size)
        pairs, first = _pair_sums(passages, size, place[columns], weights, word)

    def by_pairs(table):  # the same from the sums of all pairs
        shared = sc.broadcast((table.astype(np.float32), place))

        def make(batches):
            table, place = shared.value
            x, y = np.empty_like(table), np.zeros(table.shape)
            x[place] = table
            for batch in batches:
                for i, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    a, z = int(first[i]), int(first[i + 1])
                    sums, some, at = np.frombuffer(raw, np.float32), np.zeros((z - a, z), np.float32), 0
                    for r in range(a, z):
                        some[r - a, : r + 1] = sums[at : at + r + 1]
                        at += r + 1
                    y[a:z] += some @ x[:z]
                    y[:z] += some.T @ x[a:z]
            return y[place]

        # Every part sends a whole product, so parts are as many as tasks run at a time, however finely the table is dealt.
        out = _product(pairs.select("slab", "sums").coalesce(sc.defaultParallelism), size, width, make)
        shared.destroy()
        return out

    def by_passages(table):  # the sum of A^T (A table)
        shared = sc.broadcast((table.astype(np.float32), columns, weights, hot, often))

        def make(batches):
            table, columns, weights, hot, often = shared.value
            total = np.zeros((size, width))
            rows = np.concatenate((table[columns] * weights[:, None], np.zeros((1, width), np.float32)))
            for part, cells in chunks(batches, "ids", BLOCK):
                scales, cuts = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("scale", "cut"))
                sizes = np.fromiter(map(len, cells), np.int64, len(cells)) // np.dtype(word).itemsize
                flat = np.frombuffer(b"".join(cells), word).astype(np.int64)
                block = np.zeros((len(columns), width), np.float32)
                of = np.repeat(np.arange(len(cells)), sizes)
                for cut in np.unique(cuts):
                    mine = cuts == cut
                    _add_windows(block, flat[mine[of]], sizes[mine], scales[mine], int(cut), rows, weights, hot, often)
                block *= weights[:, None]
                for x in range(0, len(columns), step):
                    total[columns[x : x + step]] += block[x : x + step]
            return total

        out = _product(passages, size, width, make)
        shared.destroy()
        return out

    gram = by_passages if pairs is None else by_pairs
    q = np.linalg.qr(gram(np.random.default_rng(11).standard_normal((size, width))))[0]
    q = np.linalg.qr(gram(q))[0]
    small = q.T @ gram(q)
    discard(*([] if pairs is None else [pairs]))
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    top = np.argsort(-values)[: how.dims]
    top = top[values[top] > 1e-6 * max(values[top[0]], 1e-12)]
    return q @ vectors[:, top]


def passages_of(item: np.ndarray, window: int) -> list[np.ndarray]:
    """An item of up to two windows as it is, a longer one in windows that overlap by half."""
    if len(item) <= 2 * window:
        return [item]
    return [item[a : a + window] for a in [*range(0, len(item) - window, window // 2), len(item) - window]]


def heaviest_common(item: np.ndarray, text: np.ndarray, weight: np.ndarray) -> float:
    """Weight of the heaviest common subsequence of two feature sequences."""
    best = np.zeros(len(text) + 1)
    for f in item:
        hit = np.flatnonzero(text == f)
        if len(hit):
            new = best.copy()
            new[hit + 1] = np.maximum(new[hit + 1], best[hit] + weight[f])
            best = np.maximum.accumulate(new)
    return float(best[-1])


def confirmed(item: np.ndarray, answer: int, text: np.ndarray, weight: np.ndarray, how: Leaks) -> float:
    """The share of the item's weight that stands in order in some stretch of ``text``, if it is a leak, else 0."""
    whole = float(weight[item].sum())
    span, top, seen = 2 * len(item) + how.window, 0.0, np.zeros(len(weight), bool)
    for a in range(0, max(1, len(text) - len(item)), len(item) + how.window // 2):
        part = text[a : a + span]
        # Words that are not there in any order are in no common subsequence.
        seen[part] = True
        there = float(weight[item[seen[item]]].sum())
        seen[part] = False
        if there < 0.9999 * how.weak * whole:
            continue
        share = heaviest_common(item, part, weight) / whole
        if how.weak <= share < how.strong:
            last = item[len(item) - answer :] if answer else item[:0]
            if not len(last) or heaviest_common(last, part, weight) < how.strong * float(weight[last].sum()):
                share = 0.0
        top = max(top, share if share >= how.weak else 0.0)
    return top


def find_leaks(docs: DataFrame, benchmark: DataFrame, how: Leaks = Leaks()) -> DataFrame:
    """(doc_id, item_id, share) for every document that holds a benchmark item."""
    rows = benchmark.select("item_id", "text").where("text is not null")
    blocks = max(1, -(-rows.count() // how.items))
    out = None
    for b in range(blocks):  # indexes of a bounded number of items
        block = rows.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).distinct().orderBy("item_id", "text").collect()
        hits = _search(docs, [(r["item_id"], r["text"].encode()) for r in block], benchmark.schema["item_id"].dataType.simpleString(), how)
        out = hits if out is None else out.unionByName(hits)
    return out.groupBy("doc_id", "item_id").agg(F.max("share").alias("share"))


def _half_sums(cols: np.ndarray, sizes: np.ndarray, table: np.ndarray, half: int) -> np.ndarray:
    """Sums of the rows of ``table`` over each half window of texts that stand one after the other.  The table's last row is 0."""
    counts = -(-sizes // half)
    at = np.repeat(np.cumsum(sizes) - sizes, counts) + half * (np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts))
    ends = np.repeat(np.cumsum(sizes), counts)
    out = np.zeros((len(at), table.shape[1]), table.dtype)
    padded = np.append(cols, np.full(half, len(table) - 1, cols.dtype))
    for a in range(0, len(at), 1024):  # in pieces that stay in the processor's cache
        part, piece, stop = out[a : a + 1024], at[a : a + 1024], ends[a : a + 1024]
        for k in range(half):
            part += table[np.where(piece + k < stop, padded[piece + k], len(table) - 1)]
    return out


#: Windows and passages that are compared at once.
WINDOWS, QUERIES = 512, 2048


def _stretches(doc: np.ndarray, item: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of windows by text and item, where those with at most one window between them are one."""
    order = np.lexsort((first, item, doc))
    doc, item, first, last = (x[order] for x in (doc, item, first, last))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (first[1:] > last[:-1] + 2)
    heads = np.flatnonzero(new)
    return doc[heads], item[heads], first[heads], last[np.append(heads[1:], len(doc))[: len(heads)] - 1]


def near_stretches(windows: np.ndarray, lengths: np.ndarray, queries: np.ndarray, enough: np.ndarray, owner: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, item, first window, last window) of the stretches of windows (each of the text ``of``) whose product with some
    passage of the item reaches the window's length or what is ``enough``.

    Where every window is near every passage, pairs of a few windows are held at a time, then their stretches only.
    """
    found = [(np.zeros(0, np.int64),) * 4]
    kinds = int(owner.max()) + 1
    for w in range(0, len(windows), WINDOWS):
        some, least = windows[w : w + WINDOWS], lengths[w : w + WINDOWS, None]
        hits = []
        for a in range(0, len(queries), QUERIES):
            win, q = np.nonzero(some @ queries[a : a + QUERIES].T >= np.minimum(least, enough[a : a + QUERIES]))
            hits.append(np.unique(win * kinds + owner[a + q]))
        win, item = np.divmod(np.unique(np.concatenate(hits)), kinds)
        found.append(_stretches(of[w + win], item, w + win, w + win))
    return _stretches(*(np.concatenate(x) for x in zip(*found, strict=True)))


def _search(docs: DataFrame, items: list[tuple[int, bytes]], item_type: str, how: Leaks) -> DataFrame:
    spark, sc = docs.sparkSession, docs.sparkSession.sparkContext
    id_type = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, item_id {item_type}, share double"
    items = [(i, t) for i, t in items if words_of(t)]
    if not items:
        return spark.createDataFrame([], schema)
    h, sizes, _ = hashed([t for _, t in items])
    vocabulary = np.unique(h)
    size = len(vocabulary) + how.buckets
    own = np.split(h, np.cumsum(sizes)[:-1])
    brief = [k for k, n in enumerate(sizes) if n < how.least]
    table = coded(docs, vocabulary, [own[k] for k in brief], how)
    labels = spark.createDataFrame([(n, items[k][0]) for n, k in enumerate(brief)], f"f long, item_id {item_type}")
    found = table.where(F.col("kind") == SHORT).join(labels, "f").select("doc_id", "item_id", F.lit(1.0).alias("share"))

    long = [k for k, n in enumerate(sizes) if n >= how.least]
    if long:
        found = found.unionByName(_candidates(table, [items[k] for k in long], [numbered(own[k], vocabulary, how.buckets) for k in long], len(vocabulary), schema, how))
    found = materialise(found, "leaks")
    discard(table)
    return found


def _candidates(table: DataFrame, items: list[tuple[int, bytes]], item_ids: list[np.ndarray], known: int, schema: str, how: Leaks) -> DataFrame:
    """(doc_id, item_id, share): confirmed hits of items in the coded texts."""
    spark, sc = table.sparkSession, table.sparkSession.sparkContext
    size = known + how.buckets
    word = np.uint16 if size <= 1 << 16 else np.uint32
    df, n = frequencies(table, size)
    weights = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)
    own = min(known, how.features)
    columns = np.concatenate((np.arange(known) % max(1, own), own + np.arange(how.buckets)))

    cut = [(i, part) for i, x in enumerate(item_ids) for part in passages_of(x, how.window)]
    owner, parts = np.array([i for i, _ in cut]), [x for _, x in cut]
    texts = table.where((F.col("kind") == DOCUMENT) & (F.col("n") > 0))
    facts = texts.agg(F.sum("n").alias("words"), F.sum(F.ceil(F.col("n") / how.window)).alias("windows")).first()
    scale = float(np.sqrt(max(1, facts["windows"] or 0) / len(parts)))
    wanted = spark.createDataFrame([(bytearray(x.astype(word).tobytes()), scale, 2 * how.window) for x in parts], "ids binary, scale double, cut int").coalesce(1)
    columns_of = own + how.buckets
    few = -(-max(1, facts["words"] or 0) // PAIR_WORDS) if columns_of * (columns_of + 1) // 2 <= PAIRS else max(2 * sc.defaultParallelism, -(-(facts["words"] or 0) // PART_WORDS))
    passages = texts.select("ids", F.lit(1.0).alias("scale"), F.lit(how.window).alias("cut")).unionByName(wanted).coalesce(few)
    directions = latent(passages, columns_of, columns, weights, word, how)
    space = np.concatenate((directions, np.zeros((1, directions.shape[1])))).astype(np.float32)

    flat, lens = np.concatenate(parts), np.array([len(x) for x in parts])
    starts = np.cumsum(lens) - lens
    vectors = np.add.reduceat(space[columns[flat]] * weights[flat][:, None], starts, axis=0)
    norms = np.sqrt(np.add.reduceat(weights[flat] ** 2, starts))
    vectors /= norms[:, None]
    # The part of a passage that a window can hold, and of that what the latent space keeps.
    room = np.minimum(1.0, how.window / lens) * np.minimum(1.0, (vectors**2).sum(axis=1))
    enough = (how.held * room * norms).astype(np.float32)
    answers = [answer_words(t) for _, t in items]
    model = sc.broadcast((space, columns, weights, vectors.astype(np.float32), enough, owner, item_ids, answers, [i for i, _ in items]))

    def run(batches):
        space, columns, weight, queries, enough, owner, item_words, answer, labels = model.value
        rows_of = np.concatenate((space[columns] * weight[:, None], space[-1:]))  # one row a number, and the empty one
        half = how.window // 2
        for part, cells in chunks(batches, "ids", 1 << 18):
            sizes = np.fromiter(map(len, cells), np.int64, len(cells)) // np.dtype(word).itemsize
            flat = np.frombuffer(b"".join(cells), word).astype(np.int64)
            base = np.cumsum(sizes) - sizes
            rows, who, share = [], [], []
            # Half windows of 16 words; two neighbours of a text are a window.
            counts = -(-sizes // half)
            if counts.sum():
                of = np.repeat(np.arange(len(cells)), counts)
                place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                sums = _half_sums(flat, sizes, rows_of, half)
                norm = np.add.reduceat(weight[flat] ** 2, base[of] + place * half)
                joined, both = sums.copy(), norm.copy()
                more = np.flatnonzero(of[1:] == of[:-1])
                joined[more] += sums[more + 1]
                both[more] += norm[more + 1]
                for d, i, a, z in zip(*map(np.ndarray.tolist, near_stretches(joined, how.cosine * np.sqrt(both), queries, enough, owner, of)), strict=True):
                    lo, hi = int(place[a]) * half, int(place[z]) * half + how.window
                    reach = len(item_words[i])
                    got = confirmed(item_words[i], answer[i], flat[base[d] + max(0, lo - reach) : base[d] + min(int(sizes[d]), hi + reach)], weight, how)
                    if got:
                        rows.append(d)
                        who.append(labels[i])
                        share.append(round(got, 4))
            doc_id = part.column(part.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays([doc_id.take(pa.array(rows, pa.int64())), pa.array(who, out_type), pa.array(share, pa.float64())], names=["doc_id", "item_id", "share"])

    from pyspark.sql.pandas.types import to_arrow_type

    out_type = to_arrow_type(spark.createDataFrame([], schema).schema["item_id"].dataType)
    hits = materialise(table.where(F.col("kind") == DOCUMENT).select("doc_id", "ids").mapInArrow(lean(run), schema), "hits")
    model.destroy()
    return hits


def drop_leaks(docs: DataFrame, benchmark: DataFrame, how: Leaks = Leaks()) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item."""
    name = free_name(docs.columns, "gone")
    gone = find_leaks(docs, benchmark, how).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone[name]), "left_anti").select(*(f"`{c}`" for c in docs.columns))
