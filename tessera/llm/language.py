"""Language model scores: a hidden Markov model over word classes, trained by Baum-Welch.

* Counts of all words of the training texts give smoothed unigram probabilities p(w); an
  unseen word has the probability of a count of nothing.
* Every word has one of ``CLASSES`` classes by a fixed rule: the most frequent words their
  own, others one by a hash of their last two bytes, the end one of its own.  p(class) is the
  sum of p(w) over its words, and of one unseen word in classes that take such.  A hidden
  state emits a class, the class a word with p(w) / p(class), so a class's words have a sum of
  1 at most.  The logarithm of a text's probability is its unigram score, plus the likelihood
  of its class sequence by the forward recursion, minus the classes' unigram scores.
* Class sequences are stored, one byte a token.  Each Baum-Welch round reads those of the
  training texts, in segments (a segment's first state is drawn anew), sums expected counts
  in every partition and adds up the partitions' sums: a few thousand numbers in all.
* Scoring runs the scaled forward recursion over whole sequences, many texts in step.
* A bounded head of the vocabulary goes to every worker; counts of all other words are
  found by a join on their hashes, after each text has counted its own repeats.

Defined results: a null or empty text is its end token only; a null id counts as empty
text, whose remainder is 0, and so is held out; repeated rows are scored and counted row by row; an empty
table gives an empty table; with no training token N and V are 0; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import chunks, discard, materialise

CLASSES = 256
#: Classes from here on take words by their bytes; the last is the end's.
BYTES, END = 127, 255


@dataclass(frozen=True)
class Model:
    """``states`` hidden states, ``rounds`` of Baum-Welch over segments of ``segment`` tokens.
    ``head``: words (of at most ``head_bytes`` bytes) that every worker holds; ``own``: words
    with a class of their own, 127 at most.  ``add``: what smoothing adds to every count."""

    states: int = 8
    rounds: int = 3
    segment: int = 256
    head: int = 50_000
    head_bytes: int = 48
    own: int = 127
    add: float = 0.1


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, c) over all training texts; words are lower-cased UTF-8 bytes."""

    def run(batches):
        count: Counter = Counter()
        for _, texts in chunks(batches, "text"):
            for raw in texts:
                count.update(raw.lower().split())
            if len(count) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])
                count.clear()
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], names=["word", "n"])

    return docs.where(~held_out(F.col("doc_id"))).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


def class_of(word: bytes) -> int:
    """The class of a word that has none of its own: 128 by its last two bytes."""
    h = (word[-1] * 31 + (word[-2] if len(word) > 1 else 7) * 131) & 0xFFFF
    return BYTES + (h * 40503 >> 9) % 128


# ---------------------------------------------------------------- class sequences


def encode(docs: DataFrame, shared, own: int, add: float) -> DataFrame:
    """For every text, with the head (word, count) as a broadcast: tokens, how many are head words and the sum of their log10(c + add),
    its class sequence, and the other words' hashes with how often each occurs."""

    def run(batches):
        import xxhash

        classes = {w: i if i < own else class_of(w) for i, (w, _) in enumerate(shared.value)}
        counts = dict(shared.value)
        digest = xxhash.xxh64_intdigest
        for part, texts in chunks(batches, "text"):
            rows = []
            for raw in texts:
                words = raw.lower().split()
                seq = bytes([*(classes[w] if w in classes else class_of(w) for w in words), END])
                tally = Counter(words)
                known = [(counts[w], n) for w, n in tally.items() if w in counts]
                other = [(digest(w, seed=42), n) for w, n in tally.items() if w not in counts]
                rows.append((len(words) + 1, known, other, seq))
            doc_id, out = part.column(part.schema.get_field_index("doc_id")), part.column(part.schema.get_field_index("held_out"))
            sizes = [len(r[1]) for r in rows]
            flat = np.array([x for r in rows for x in r[1]], np.int64).reshape(-1, 2)
            of = np.repeat(np.arange(len(rows)), sizes)
            head_known = np.bincount(of, flat[:, 1], len(rows)).astype(np.int64)
            ends = np.cumsum([0, *(len(r[2]) for r in rows)]).astype(np.int32)
            tail = np.array([x for r in rows for x in r[2]], np.uint64).reshape(-1, 2)
            hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(tail[:, 0].copy().view(np.int64)))
            times = pa.ListArray.from_arrays(pa.array(ends), pa.array(tail[:, 1].astype(np.int32)))
            logs = np.bincount(of, flat[:, 1] * np.log10(flat[:, 0] + add), len(rows)).astype(float)  # of no words at all, bincount gives integers
            yield pa.RecordBatch.from_arrays([doc_id, out, pa.array([r[0] for r in rows], pa.int64()), pa.array(head_known), pa.array(logs), hashes, times, pa.array([r[3] for r in rows], pa.binary())], names=["doc_id", "held_out", "n_tokens", "head_known", "head_logs", "hashes", "times", "classes"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, held_out boolean, n_tokens long, head_known long, head_logs double, hashes array<long>, times array<int>, classes binary")


# ---------------------------------------------------------------- hidden Markov model


class Hmm:
    """Start, transition and emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, states: int, share: np.ndarray) -> Hmm:
        """States that differ a little from the classes' shares, and tend to stay."""
        rnd = np.random.default_rng(7)
        emit = share[None, :] * rnd.uniform(0.5, 1.5, (states, len(share)))
        move = np.full((states, states), 0.3 / states) + np.eye(states) * 0.7
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    @classmethod
    def of_counts(cls, start: np.ndarray, move: np.ndarray, emit: np.ndarray, share: np.ndarray) -> Hmm:
        """Expected counts, with a little added so that nothing has probability 0."""
        start, move, emit = start + 1e-3, move + 1e-3, emit + share[None, :] + 1e-9
        return cls(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def _in_step(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest first: order, lengths, and the sequences as columns of one padded array."""
    size = np.fromiter(map(len, sequences), np.int64, len(sequences))
    order = np.argsort(-size, kind="stable")
    grid = np.zeros((int(size.max()), len(sequences)), sequences[0].dtype)
    for to, at in enumerate(order):
        grid[: size[at], to] = sequences[at]
    return order, size[order], grid


def forward(model: Hmm, sequences: list[np.ndarray]) -> np.ndarray:
    """log10 likelihood of each (non-empty) class sequence, by the scaled forward recursion."""
    order, size, grid = _in_step(sequences)
    live = np.searchsorted(-size, -np.arange(len(grid)), side="left")  # sequences longer than t
    emit = np.ascontiguousarray(model.emit.T)
    a = model.start[None, :] * emit[grid[0]]
    total = np.zeros(len(sequences))
    for t in range(len(grid)):
        if t:
            n = live[t]
            a = (a[:n] @ model.move) * emit[grid[t, :n]]
        s = a.sum(1)
        total[: len(s)] += np.log10(s)
        a /= s[:, None]
    out = np.empty(len(sequences))
    out[order] = total
    return out


def expected(model: Hmm, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch sums over the sequences: of first states, moves, and emissions."""
    k = len(model.start)
    _, size, grid = _in_step(sequences)
    live = np.searchsorted(-size, -np.arange(len(grid)), side="left")
    emit = np.ascontiguousarray(model.emit.T)
    alpha, scale = [], []
    for t in range(len(grid)):
        n = live[t] if t else len(sequences)
        a = (alpha[-1][:n] @ model.move if t else np.broadcast_to(model.start, (n, k))) * emit[grid[t, :n]]
        s = a.sum(1)
        alpha.append(a / s[:, None])
        scale.append(s)
    move, flat, seen = np.zeros((k, k)), [], []
    beta = np.ones((len(alpha[-1]), k))
    for t in range(len(grid) - 1, -1, -1):
        flat.append(alpha[t] * beta)
        seen.append(grid[t, : len(beta)])
        if t:
            back = beta * emit[grid[t, : len(beta)]] / scale[t][:, None]
            move += alpha[t - 1][: len(back)].T @ back
            wide = np.ones((len(alpha[t - 1]), k))
            wide[: len(back)] = back @ model.move.T
            beta = wide
    gamma, seen = np.concatenate(flat), np.concatenate(seen)
    sums = np.stack([np.bincount(seen, gamma[:, i], model.emit.shape[1]) for i in range(k)])
    return flat[-1].sum(0), move * model.move, sums


def _groups(batches, most: int = 1 << 18):
    """Batches' rows in groups of about ``most`` padded tokens."""
    for batch in batches:
        seqs = [np.frombuffer(x, np.uint8) for x in batch.column(batch.schema.get_field_index("classes")).to_pylist()]
        order = sorted(range(len(seqs)), key=lambda i: -len(seqs[i]))
        at = 0
        while at < len(order):
            to = at + max(1, most // len(seqs[order[at]]))
            yield batch, seqs, order[at:to]
            at = to


def shares(words: DataFrame, head: list[tuple[bytes, int]], own: int, add: float, ends: int) -> np.ndarray:
    """p(class) of all classes: the smoothed p(w) of the vocabulary ``words`` (word, c) that are in it,
    and of one unseen word where words come by their bytes; ``ends``: texts, each with its end."""
    first = {w: i for i, (w, _) in enumerate(head[:own])}

    def run(batches):
        count, kinds = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for batch in batches:
            of = np.array([first[w] if w in first else class_of(w) for w in batch.column(0).to_pylist()], np.int64)
            count += np.bincount(of, batch.column(1).to_numpy(), CLASSES).astype(np.int64)
            kinds += np.bincount(of, minlength=CLASSES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(CLASSES)), pa.array(count), pa.array(kinds)], names=["i", "c", "v"])

    out = np.zeros(CLASSES)
    n, v = ends, 1 if ends else 0
    for r in words.select("word", "c").mapInArrow(run, "i long, c long, v long").groupBy("i").agg(F.sum("c").alias("c"), F.sum("v").alias("v")).collect():  # CLASSES rows
        out[r["i"]] = r["c"] + add * r["v"]
        n, v = n + r["c"], v + r["v"]
    out[END] = ends + add
    out[BYTES : END] += add
    out[:BYTES] = np.maximum(out[:BYTES], add)  # classes of their own that the vocabulary is too small to use
    return out / (n + add * (v + 1))


def train(coded: DataFrame, model: Model, share: np.ndarray) -> Hmm:
    """The model fitted to the training texts' class sequences; ``share``: p(class)."""
    training = coded.where("not held_out").select("classes")
    k = model.states
    share = share / share.sum()
    hmm = Hmm.first(k, share)
    for _ in range(model.rounds):

        def sums(batches, hmm=hmm):
            total = np.zeros(k + k * k + k * CLASSES)
            pieces, held = [], 0

            def flush():
                nonlocal total, pieces, held
                if pieces:
                    total = total + np.concatenate([x.reshape(-1) for x in expected(hmm, pieces)])
                pieces, held = [], 0

            for batch in batches:
                for x in batch.column(0).to_pylist():
                    seq = np.frombuffer(x, np.uint8)
                    for at in range(0, len(seq), model.segment):
                        pieces.append(seq[at : at + model.segment])
                        held += model.segment
                    if held > 1 << 18:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "n"])

        total = np.zeros(k + k * k + k * CLASSES)
        for r in training.mapInArrow(sums, "i long, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():  # as many rows as the model has numbers
            total[r["i"]] = r["n"]
        hmm = Hmm.of_counts(total[:k], total[k : k + k * k].reshape(k, k), total[k + k * k :].reshape(k, CLASSES), share)
    return hmm


def score(docs: DataFrame, model: Model = Model()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``."""
    docs = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    words = materialise(vocabulary(docs), "words")
    # The end token is a word of its own, once a training text.
    n_train = docs.where("not held_out").select("doc_id").count()
    facts = words.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    n, v = facts["n"] + n_train, facts["v"] + (n_train > 0)
    top = words.where(F.length("word") <= model.head_bytes).orderBy(F.desc("c"), "word").limit(model.head)
    # The top is merged on an executor; what comes to the driver is head words of head_bytes bytes at most.
    top = materialise(top, "head")
    head = [(bytes(r["word"]), r["c"]) for r in top.collect()]
    discard(top)

    shared = docs.sparkSession.sparkContext.broadcast(head)
    coded = materialise(encode(docs, shared, model.own, model.add).withColumn("row", F.monotonically_increasing_id()), "coded")  # ids are written, so they stay
    shared.destroy()
    share = shares(words, head, model.own, model.add, n_train)
    hmm = train(coded, model, share)

    # Counts of the words outside the head: hashes of a text's own words against the vocabulary's.
    rare = words.select(F.xxhash64("word").alias("hash"), "c")
    tail = coded.select("row", F.explode(F.arrays_zip("hashes", "times")).alias("w")).select("row", F.col("w.hashes").alias("hash"), F.col("w.times").alias("t"))
    tail = tail.join(rare, "hash").groupBy("row").agg(F.sum("t").alias("tail_known"), F.sum(F.col("t") * (F.log10(F.col("c") + model.add) - math.log10(model.add))).alias("tail_logs"))

    logs = np.log10(share)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def likelihood(batches):
        names = ["row", "doc_id", "held_out", "n_tokens", "head_known", "head_logs"]
        for batch, seqs, of in _groups(batches):
            part = batch.take(pa.array(of))
            own = [seqs[i] for i in of]
            gain = forward(hmm, own) - np.fromiter((logs[s].sum() for s in own), float, len(own))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(gain)], names=[*names, "gain"])

    gains = coded.select("row", "doc_id", "held_out", "n_tokens", "head_known", "head_logs", "classes").mapInArrow(likelihood, f"row long, doc_id {id_type}, held_out boolean, n_tokens long, head_known long, head_logs double, gain double")
    out = gains.join(tail, "row", "left")
    end_known = 1 if n_train else 0
    known = F.col("head_known") + F.coalesce("tail_known", F.lit(0)) + end_known
    # Sum of log10(c + add): head words, the end, other words as if unseen, and what seen ones add.
    unseen = F.col("n_tokens") - 1 - F.col("head_known")
    logs_sum = F.col("head_logs") + unseen * math.log10(model.add) + F.coalesce("tail_logs", F.lit(0.0)) + math.log10(n_train + model.add)
    base = logs_sum - F.col("n_tokens") * math.log10(n + model.add * (v + 1))
    return out.select("doc_id", "held_out", "n_tokens", known.cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain")).alias("score"))
