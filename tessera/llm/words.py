"""Language model scores: a hidden Markov model whose states emit words, trained by Baum-Welch.

* Texts are cut into blocks of whole texts; a block holds its word sequences as places in its own
  sorted dictionary of word hashes (64 bits).  Dictionaries are dealt by hash into buckets, where a
  word of several blocks meets, so every word of the corpus has emissions of its own and no machine
  holds the vocabulary.
* The first meeting gives the counts c of all training texts, from which base scores and the
  states' first emissions come.  Each Baum-Welch round then sums every block's expected counts
  (a block's text in segments, whose first states are drawn anew), and the buckets add them up by word.
* Blocks and buckets pass through Python workers as sorted rows of some hundred kilobytes, batch by
  batch: a worker holds the emissions of one block, and of its texts a few at a time.
* A state's emissions are its expected counts and ``add * (V + 1)`` counts dealt by the smoothed
  unigram p(w): they sum to 1 over all words of training texts and one unseen word.
* Scoring runs the scaled forward recursion over whole texts, many in step.

Defined results: as in ``language``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, discard, lean, materialise, mix, word_stream
from tessera.llm.language import Model, held_out

#: Bytes of text in a block (the more, the fewer words stand in several blocks) and of text a bucket; bytes of text whose words are
#: numbered at once; and of text in one row of a block (or one longer text), so that no row takes more than some hundred kilobytes
#: of a JVM: arrays of half a megabyte and more stand apart in its heap.
BLOCK_BYTES, BUCKET_BYTES, STEP_BYTES, PIECE_BYTES = 32 << 20, 32 << 20, 4 << 20, 128 << 10
#: Least bits of a bucket's number: a block's words of one bucket are one row.
BITS = 7
#: Padded tokens that the recursions handle at once, tokens of texts read before, bytes of a batch of results, and in how many parts,
#: one after the other, blocks and buckets meet, so that a part of the tables is in shuffle files at a time.
GROUP, READ, OUT_BYTES, PARTS = 1 << 17, 1 << 20, 512 << 10, 3


def blocks(docs: DataFrame, bits: int) -> DataFrame:
    """(block, bucket, doc_ids, held, sizes, seq, hashes, counts): of every block rows with its texts, piece by piece (bucket -1, -2
    and so on), and one for each bucket of its dictionary with the words' hashes and how often its training texts have them."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    names = ["block", "bucket", "doc_ids", "held", "sizes", "seq", "hashes", "counts"]

    def run(batches):
        from pyspark import TaskContext

        block, held_bytes = TaskContext.get().partitionId() << 32, 0
        pieces, steps, waiting, waiting_bytes = [], [], [], 0

        def step():
            """Numbers the words of the waiting pieces: their own dictionary, how often training texts have its words, and the words' places in it."""
            nonlocal waiting, waiting_bytes
            known, at = np.unique(np.concatenate([words for words, _ in waiting]), return_inverse=True)
            at = at.astype(np.int32)
            steps.append((known, np.bincount(at[np.concatenate([training for _, training in waiting])], minlength=len(known)), np.split(at, np.cumsum([len(words) for words, _ in waiting])[:-1])))
            waiting, waiting_bytes = [], 0

        def done():
            known = np.unique(np.concatenate([x for x, _, _ in steps]))
            counts, left = np.zeros(len(known), np.int64), iter(enumerate(pieces))
            whole = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            for own, n, places in steps:
                at = np.searchsorted(known, own).astype(np.int32)
                counts[at] += n
                for seq in places:
                    i, (ids, held, sizes) = next(left)
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1 - i], pa.int32()), whole(ids), whole(pa.array(held)), whole(pa.array(sizes)), pa.array([at[seq].tobytes()], pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())], names=names)
            bucket = (known >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(known), np.int64)
            ends = np.searchsorted(bucket, np.arange((1 << bits) + 1))
            some = [b for b in range(1 << bits) if ends[b] < ends[b + 1]]
            none = [pa.nulls(len(some), t) for t in (pa.list_(ids.type), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary())]
            cells = [pa.array([x[ends[b] : ends[b + 1]].tobytes() for b in some], pa.binary()) for x in (known, counts)]
            yield from _slices(pa.RecordBatch.from_arrays([pa.array([block] * len(some), pa.int64()), pa.array(some, pa.int32()), *none, *cells], names=names))

        for part, texts in chunks(batches, "text", min(PIECE_BYTES, BLOCK_BYTES)):
            words, sizes = word_stream(texts)
            held = part.column(part.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False)
            pieces.append((part.column(part.schema.get_field_index("doc_id")), held, sizes.astype(np.int64)))
            waiting.append((words, np.repeat(~held, sizes)))
            held_bytes, waiting_bytes = held_bytes + (size := sum(map(len, texts))), waiting_bytes + size
            if waiting_bytes >= STEP_BYTES or held_bytes >= BLOCK_BYTES:
                step()
            if held_bytes >= BLOCK_BYTES:
                yield from done()
                block, pieces, steps, held_bytes = block + 1, [], [], 0
        if waiting:
            step()
        if pieces:
            yield from done()

    return docs.mapInArrow(lean(run), f"block long, bucket int, doc_ids array<{id_type}>, held array<boolean>, sizes array<long>, seq binary, hashes binary, counts binary")


# ---------------------------------------------------------------- rows, batch by batch


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about OUT_BYTES."""
    rows = max(1, batch.num_rows * OUT_BYTES // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Each value of ``key``, by which the batches' rows are sorted, with its rows, which are read as they are asked for."""

    def rows():
        for batch in batches:
            for i in range(batch.num_rows):
                yield {name: batch.column(j)[i] for j, name in enumerate(batch.schema.names)}

    return groupby(rows(), lambda r: r[key].as_py())


def _array(cell: pa.Scalar, of) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), of)


MEET = "block long, bucket int, place binary, counts binary, numbers binary, sums binary"


def _meeting(k: int, add: float, extra: float, per: float, first: bool):
    """For mapInArrow, of rows sorted by bucket: of each bucket the words' numerators of emissions.  The first time, from hashes: ``place``
    numbers the bucket's words, ``counts`` are those of the corpus, and ``sums`` (N, V, numerators' sums) stand in one row; later from
    ``numbers``, expected counts."""
    names = ["block", "bucket", "place", "counts", "numbers", "sums"]

    def run(batches):
        for bucket, rows in _groups(batches, "bucket"):
            sums, counts, of, own = None, None, [], []
            if first:
                given = []
                for r in rows:
                    of.append(r["block"].as_py())
                    own.append(_array(r["hashes"], np.uint64).copy())
                    given.append(_array(r["counts"], np.int64).copy())
                known = np.unique(np.concatenate(own))
                own, counts = [np.searchsorted(known, x).astype(np.int32) for x in own], np.zeros(len(known), np.int64)
                for at, n in zip(own, given, strict=True):
                    counts[at] += n
                seen = counts > 0
                near = np.stack([0.5 + (mix(known + np.uint64(s + 1)) >> np.uint64(11)) / 2.0**53 for s in range(k)], 1)
                numerators = (counts + add)[:, None] * np.where(seen[:, None], near, 1.0)
                sums = np.concatenate(([counts.sum(), seen.sum()], numerators[seen].sum(0))).tobytes()
            else:
                total = np.zeros((0, k))
                for r in rows:  # a block has a word once
                    of.append(r["block"].as_py())
                    own.append(at := _array(r["place"], np.int32).copy())
                    if at.max() >= len(total):
                        total = np.concatenate((total, np.zeros((at.max() + 1 - len(total), k))))
                    total[at] += _array(r["numbers"], np.float32).reshape(-1, k)
                numerators = total + extra * (total.sum(1, keepdims=True) + add) / per  # a word's expected counts sum to its count
            numerators = numerators.astype(np.float32)
            most = max(1, OUT_BYTES // (max(map(len, own)) * (4 * k + 12)))
            for a in range(0, len(own), most):
                part = own[a : a + most]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(of[a : a + most], pa.int64()),
                        pa.array([bucket] * len(part), pa.int32()),
                        pa.array([x.tobytes() for x in part], pa.binary()),
                        pa.array([counts[x].tobytes() for x in part] if first else [None] * len(part), pa.binary()),
                        pa.array([numerators[x].tobytes() for x in part], pa.binary()),
                        pa.array([sums if a + i == 0 else None for i in range(len(part))], pa.binary()),
                    ],
                    names=names,
                )

    return lean(run)


def _emissions(rows: Iterator[dict], k: int, end: np.ndarray) -> tuple[list[tuple[int, bytes]], np.ndarray, Iterator[dict]]:
    """Of a block's rows: by bucket what they tell besides numerators (places or counts), the numerators by word and last of the end,
    and the rows with texts that follow."""
    few, numbers, r = [], [], None
    for r in rows:
        if r["bucket"].as_py() < 0:
            break
        if r["numbers"].is_valid:
            numbers.append(_array(r["numbers"], np.float32).copy())
        if r["cells"].is_valid:
            few.append((r["bucket"].as_py(), r["cells"].as_py()))
    else:
        r = None
    emit = np.concatenate([*numbers, end.astype(np.float32)]).reshape(-1, k)

    def texts():
        if r is not None:
            yield r
            yield from rows

    return few, emit, texts()


def _readings(rows: Iterator[dict]) -> Iterator[tuple[list[dict], list[np.ndarray]]]:
    """A block's rows of texts with the word places of each text, about READ tokens at a time."""
    some, seqs, n = [], [], 0
    for r in rows:
        seq, sizes = _array(r["seq"], np.int32), r["sizes"].values.to_numpy()
        some.append(r)
        seqs += np.split(seq, np.cumsum(sizes)[:-1])
        n += len(seq)
        if n >= READ:
            yield some, seqs
            some, seqs, n = [], [], 0
    if some:
        yield some, seqs


def _in_step(seqs: list[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(Non-empty) sequences in groups of about GROUP padded tokens, longest first: their places, lengths, the sequences as columns of
    one padded array, and of each of its rows how many sequences reach it."""
    order, at = sorted(range(len(seqs)), key=lambda i: -len(seqs[i])), 0
    while at < len(order):
        of = order[at : at + max(1, GROUP // len(seqs[order[at]]))]
        at += len(of)
        size = np.fromiter((len(seqs[i]) for i in of), np.int64, len(of))
        inside = np.arange(size[0]) < size[:, None]
        grid = np.zeros(inside.shape, np.int32)
        grid[inside] = np.concatenate([seqs[i] for i in of])
        yield of, size, np.ascontiguousarray(grid.T), inside.sum(0)


def _emitted(emit: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """Emissions by step, state and sequence: what the recursions multiply stands in a row of memory."""
    return np.ascontiguousarray(emit[grid].transpose(0, 2, 1), np.float64)


def forward(start: np.ndarray, move: np.ndarray, emit: np.ndarray, seqs: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each (non-empty) sequence, by the scaled forward recursion; ``emit``: by word and state."""
    out, back = np.empty(len(seqs)), np.ascontiguousarray(move.T)
    for of, _, grid, live in _in_step(seqs):
        e, scale = _emitted(emit, grid), np.ones(grid.shape)
        for t, n in enumerate(live):
            a = e[t, :, :n]
            a *= back @ e[t - 1, :, :n] if t else start[:, None]
            s = np.sum(a, 0, out=scale[t, :n])
            a /= s
        out[of] = np.log10(scale).sum(0)
    return out


def expected(start: np.ndarray, move: np.ndarray, emit: np.ndarray, seqs: list[np.ndarray], sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Baum-Welch sums over (non-empty) sequences: of first states and moves; those of emissions are added to ``sums``, by word and state."""
    k, back = len(start), np.ascontiguousarray(move.T)
    first, moves, place = np.zeros(k), np.zeros((k, k)), np.empty(len(emit), np.int32)
    for _, _, grid, live in _in_step(seqs):
        e = _emitted(emit, grid)
        alpha = np.zeros_like(e)
        for t, n in enumerate(live):
            a = alpha[t, :, :n]
            np.multiply(e[t, :, :n], back @ alpha[t - 1, :, :n] if t else start[:, None], out=a)
            s = a.sum(0)
            a /= s
            e[t, :, :n] /= s
        beta = np.ones((k, live[-1]))
        for t in range(len(live) - 1, -1, -1):
            n, wide = live[t], np.ones((k, live[t - 1])) if t else None
            if t:
                after = beta * e[t, :, :n]
                moves += alpha[t - 1, :, :n] @ after.T
                wide[:, :n] = move @ after
            alpha[t, :, :n] *= beta
            beta = wide
        first += alpha[0].sum(1)
        used = np.zeros(len(emit), bool)
        used[grid] = True
        used = np.flatnonzero(used)
        place[used] = np.arange(len(used), dtype=np.int32)
        at = place[grid].ravel()
        for s in range(k):  # where a sequence has ended, alpha is 0
            sums[used, s] += np.bincount(at, alpha[:, s].ravel(), len(used))
    return first, moves * move


def score(docs: DataFrame, model: Model = Model()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    docs, k, add = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id"))), model.states, model.add
    facts = docs.agg(F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.when(~F.col("held_out"), 1).otherwise(0)).alias("n")).first()
    n_train, n_bytes, cores = facts["n"] or 0, facts["bytes"] or 0, docs.sparkSession.sparkContext.defaultParallelism
    bits = min(12, max(BITS, (n_bytes // BUCKET_BYTES).bit_length()))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    # Small partitions of the input together make a block, as many as keep all cores busy.
    coded = materialise(blocks(docs.coalesce(cores * max(1, -(-n_bytes // (BLOCK_BYTES * cores)))), bits), "blocks", large=True)
    texts = coded.where("bucket < 0").select("block", "bucket", "doc_ids", "held", "sizes", "seq")

    def meeting(rows: DataFrame, extra: float = 0.0, per: float = 1.0, first: bool = False) -> list[DataFrame]:
        own = lambda p: rows.where(F.col("bucket") % PARTS == p).repartition("bucket").sortWithinPartitions("bucket", "block")
        return [materialise(own(p).mapInArrow(_meeting(k, add, extra, per, first), MEET), "emissions", large=True) for p in range(PARTS)]

    def union(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    def by_block(emissions: DataFrame, part: int | None = None) -> DataFrame:
        """Every block's emissions by bucket, then its texts piece by piece."""
        rows = emissions.unionByName(texts, allowMissingColumns=True)
        if part is not None:
            rows = rows.where(F.pmod(F.shiftright("block", 32) + F.col("block"), F.lit(PARTS)) == part)
        return rows.repartition("block").sortWithinPartitions("block", F.col("bucket") < 0, F.abs("bucket"))

    now = meeting(coded.where("bucket >= 0").select("block", "bucket", "hashes", "counts"), first=True)
    texts = materialise(texts, "texts", large=True)
    discard(coded)  # hashes are of no more use
    counts = materialise(union(now).select("block", "bucket", F.col("counts").alias("cells")), "counts", large=True)
    total = np.zeros(2 + k)
    for r in union(now).where("sums is not null").select("sums").collect():  # a row a bucket, 4096 at most
        total += np.frombuffer(r["sums"])
    n, v = int(total[0]) + n_train, int(total[1]) + (n_train > 0)
    per, extra = n + add * (v + 1), add * (v + 1)
    norm = total[2:] + add + (n_train + add if n_train else 0)  # and an unseen word, and the end
    start, move, end = np.full(k, 1 / k), np.full((k, k), 0.3 / k) + np.eye(k) * 0.7, np.full(k, n_train + add)

    for _ in range(model.rounds):

        def sums(batches, start=start / norm, move=move / norm, end=end):  # emissions are their numerators, divided by norm here
            names = ["block", "bucket", "place", "numbers", "few"]
            for block, rows in _groups(batches, "block"):
                few, emit, rest = _emissions(rows, k, end)
                first, moves, counted, last = np.zeros(k), np.zeros((k, k)), np.zeros((len(emit), k)), len(emit) - 1
                for some, seqs in _readings(rest):
                    pieces = []
                    for seq, out in zip(seqs, (x for r in some for x in r["held"].values.to_numpy(zero_copy_only=False)), strict=True):
                        if not out:
                            seq = np.append(seq, np.int32(last))
                            pieces += [seq[a : a + model.segment] for a in range(0, len(seq), model.segment)]
                    for x, more in zip((first, moves), expected(start, move, emit, pieces, counted), strict=True):
                        x += more
                del emit
                own = np.concatenate((first, moves.ravel(), counted.sum(0), counted[last])).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([-1], pa.int32()), *[pa.nulls(1, pa.binary())] * 2, pa.array([own], pa.binary())], names=names)
                at = 0
                for bucket, place in few:
                    to = at + len(place) // 4
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([place], pa.binary()), pa.array([counted[at:to].astype(np.float32).tobytes()], pa.binary()), pa.nulls(1, pa.binary())], names=names)
                    at = to

        emissions = union(now).select("block", "bucket", F.col("place").alias("cells"), "numbers")
        tables = [materialise(by_block(emissions, p).mapInArrow(lean(sums), "block long, bucket int, place binary, numbers binary, few binary"), "expected", large=True) for p in range(PARTS)]
        counted = union(tables)
        discard(*now)

        def together(t: pa.Table) -> pa.Table:
            return pa.table([pa.array([sum(np.frombuffer(x) for x in t.column("few").to_pylist()).tobytes()], pa.binary())], names=["few"])

        few = np.zeros(3 * k + k * k)
        parts = counted.where("bucket = -1").select((F.col("block") % 64).alias("part"), "few")
        for r in parts.groupBy("part").applyInArrow(together, "few binary").collect():  # 64 rows at most
            few += np.frombuffer(r["few"])
        now = meeting(counted.where("bucket >= 0").drop("few"), extra, per)
        discard(*tables)
        start, move, mass, ended = few[:k] + 1e-3, few[k : k + k * k].reshape(k, k) + 1e-3, few[-2 * k : -k], few[-k:]
        norm = mass + (extra if n_train else extra * (per + add) / per)  # with no training text the end is not among the V
        start, move, end = start / start.sum(), move / move.sum(1, keepdims=True), ended + extra * (n_train + add) / per

    def likelihood(batches, start=start / norm, move=move / norm, end=end):
        for _, rows in _groups(batches, "block"):
            few, emit, rest = _emissions(rows, k, end)
            c = np.concatenate([*(np.frombuffer(x, np.int64) for _, x in few), np.array([n_train])])
            logs = np.log10((c + add) / per)
            for some, seqs in _readings(rest):
                seqs = [np.append(x, np.int32(len(emit) - 1)) for x in seqs]
                sizes, flat = np.fromiter(map(len, seqs), np.int64, len(seqs)), np.concatenate(seqs)
                heads = np.cumsum(sizes) - sizes
                known, base = np.add.reduceat((c[flat] > 0).astype(np.int64), heads), np.add.reduceat(logs[flat], heads)
                ids, held = (pa.concat_arrays([r[x].values for r in some]) for x in ("doc_ids", "held"))
                yield pa.RecordBatch.from_arrays([ids, held, pa.array(sizes), pa.array(known), pa.array(base), pa.array(forward(start, move, emit, seqs))], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    known = union(now).select("block", "bucket", "numbers").unionByName(counts, allowMissingColumns=True)
    out = materialise(by_block(known).mapInArrow(lean(likelihood), f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double"), "scores", large=True)
    discard(texts, counts, *now)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
