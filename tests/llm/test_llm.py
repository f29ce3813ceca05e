"""Each operator against a brute-force version on small fixtures, and on hostile tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import components, language, leaks, licenses, lines, mixing, near, passages, private, quality, queries, tokens
from tessera.llm import common
from tessera.llm import words as word_model
from tessera.llm.common import free_name
from tessera.llm.oracles import ORACLES

RND = random.Random(5)
VOCAB = ["".join(RND.choice("abdeilnorstuäé") for _ in range(RND.randint(2, 9))) for _ in range(900)]


def prose(n, rnd=RND):
    words = [rnd.choice(VOCAB[:60]) if rnd.random() < 0.4 else rnd.choice(VOCAB) for _ in range(n)]
    out = ""
    for i, w in enumerate(words):
        out += w + (".\n" if i % 23 == 22 else ". " if i % 11 == 10 else " ")
    return out.strip()


def edited(text, k, rnd=RND):
    w = text.split(" ")
    for _ in range(k):
        w[rnd.randrange(len(w))] = rnd.choice(VOCAB) + "x"
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    base = [prose(RND.randint(60, 260)) for _ in range(60)]
    texts = list(base)
    for i in range(12):
        texts += [base[i]] * (1 + i % 3)  # exact copies
        texts += [edited(base[i], k) for k in (1, 1, 2, 3, 5, 9)]  # near copies, some beyond the threshold
    passage = prose(64)
    for i in range(20, 30):  # a passage within other texts
        w = base[i].split(" ")
        texts.append(" ".join(w[:31] + passage.split(" ") + w[31:]))
    texts += ["", "   \n\t ", "one", "two words", "One", None]
    texts += ["write to a.b@mail.example.org or +1 (555) 010-9988 now, 10.0.0.300 and 10.20.30.40; card 4111 1111 1111 1111 ok"]
    return [(i, t, f"s{i % 7}" if i % 11 else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, "doc_id long, text string, source string").repartition(5).cache()


def words(t):
    return (t or "").encode().lower().split()


def shingles(t, k=5):
    w = words(t)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def groups(nodes, edges):
    up = {n: n for n in nodes}

    def root(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


# ---------------------------------------------------------------- near duplicates


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 150), (3, 3)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    want = groups({x for e in edges for x in e if e[0] != e[1]}, [e for e in edges if e[0] != e[1]])
    assert got == want
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    rnd = random.Random(2)
    some, more = ([(rnd.randrange(300), rnd.randrange(300)) for _ in range(n)] for n in (120, 60))
    parts = components.connected_components(spark.createDataFrame(some, "a long, b long"))
    got = dict(components.joined_components(parts, spark.createDataFrame(more, "a long, b long")).collect())
    edges = [e for e in some + more if e[0] != e[1]]
    assert got == groups({x for e in edges for x in e}, edges)
    assert dict(components.joined_components(parts, spark.createDataFrame([], "a long, b long")).collect()) == dict(parts.collect())


def test_super_min_hash_estimates_similarity():
    rnd = np.random.default_rng(3)
    a = rnd.integers(0, 2**63, 300).astype(np.uint64)
    sets = [np.unique(np.concatenate((a[: 300 - k], rnd.integers(0, 2**63, k).astype(np.uint64)))) for k in (0, 50, 150)]
    sig = near.super_min_hash(sets, 64)
    same = [(sig[0] == s).mean() for s in sig]
    assert same[0] == 1 and abs(same[1] - 250 / 350) < 0.2 and abs(same[2] - 150 / 450) < 0.2
    small = near.super_min_hash([a[:3], a[:3], a[1:4]], 64)
    assert (small[0] == small[1]).all() and 0 < (small[0] == small[2]).mean() < 1
    steps = (small >> np.uint64(32)).astype(int)
    assert all(Counter(steps[0])[j] <= 3 for j in range(64))  # each element fills one slot a step


def test_near_duplicates(docs, corpus):
    sets = {i: shingles(t) for i, t, _ in corpus}
    edges = [(i, j) for i in sets for j in sets if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    want = groups(sets, edges)
    got = {r["doc_id"]: r for r in near.near_duplicates(docs).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(sets[i]) and r["kept"] == (want[i] == i) for i, r in got.items())
    left = near.drop_near_duplicates(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == set(want.values())


def test_many_near_copies_of_one_text(spark):
    rnd = random.Random(9)
    base = prose(150, rnd)
    texts = [base] + [edited(base, rnd.choice([1, 2, 3, 4, 6]), rnd) for _ in range(150)]
    sets = {i: shingles(t) for i, t in enumerate(texts)}
    edges = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    got = {r[0]: r[2] for r in near.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == groups(sets, edges)


# ---------------------------------------------------------------- lines


def test_line_dedup(spark):
    rnd = random.Random(4)
    pool = [" ".join(rnd.choice(VOCAB) for _ in range(rnd.choice([1, 2, 3, 4, 5, 6, 7, 9, 12, 30, 255, 256, 257, 700]))) for _ in range(40)]

    def variant(line):
        w = line.split(" ")
        k = rnd.randrange(len(w))
        return " ".join(rnd.choice([w[:k] + w[k + 1 :], w[:k] + ["neu"] + w[k:], w[:k] + ["neu"] + w[k + 1 :], w]))

    rows = [(i, rnd.choice(["\n", " \n", "\r\n\t"]).join(variant(rnd.choice(pool)).replace(" ", rnd.choice([" ", "  ", "\t"]), 1) if rnd.random() < 0.8 else prose(12, rnd).replace("\n", " ") for _ in range(rnd.randint(1, 9)))) for i in range(80)]
    flat = [(i, n, tuple(words_of)) for i, t in rows for n, x in enumerate(t.split("\n")) if (words_of := x.split())]

    def apart(a, b):
        if abs(len(a) - len(b)) > 1 or len(min(a, b, key=len)) < 5 and a != b:
            return a == b
        p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a == b or a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]

    first = {}
    for i, n, w in flat:
        first.setdefault(w, (i, n))
    gone = {w for w in first if any(first[v] < first[w] and apart(v, w) for v in first)}
    want = defaultdict(list)
    for i, n, w in flat:
        if first[w] != (i, n) or w in gone:
            want[i].append(n)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["removed"] for r in lines.line_report(docs).collect()}
    assert got == {i: want[i] for i, _ in rows}
    kept = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs).collect()}
    for i, t in rows:
        left = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i])
        assert kept.get(i) == (left if left.split() or not t.split() else None)


# ---------------------------------------------------------------- personal data

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub(r"[^0-9]", "", m)) <= 19 and luhn(re.sub(r"[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_of(t):
    return sorted((m.start(), k, m.end(), name) for k, (name, pat, ok) in enumerate(KINDS) for m in re.finditer(pat, t) if ok(m[0]))


def test_base_spans(spark):
    rnd = random.Random(8)
    bits = ["a@b.c", "@", ".", "-", "+", "_", "%", " ", "x", "é", "1", "22", "255", "256", "0007", "\n", "(", ")", "4111 1111 1111 1111", "+1 (555) 010-9988", "1.2.3.4", "😀", "a.b@c-d.ef", "@@", ".."]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 30))) for _ in range(1500)] + ["a" * 30000, "1 " * 9000, "a@b" + ".c" * 9000, "", "1.2.3.4" * 50]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in private.personal_data(rows).collect():
        base = base_of(texts[r["doc_id"]])
        text = ",".join(f"{n}:{a}:{b}" for a, _, b, n in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [r[f"n_{k}"] for k, _, _ in KINDS] == [sum(s[3] == k for s in base) for k, _, _ in KINDS]
        assert set(text.split(",")) <= set(r["spans"].split(",")) | {""}


def test_disclosing_terms(spark):
    rnd = random.Random(2)
    rows = [(i, prose(80, rnd)) for i in range(200)]
    rows += [(1000 + i, f"{prose(40, rnd)} the Zanzibarski desk {rnd.choice(VOCAB)} uses zb.desk@corp.example.com {rnd.choice(VOCAB)} {prose(30, rnd)}") for i in range(8)]
    rows += [(2000, prose(40, rnd) + " Zanzibarski elsewhere")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in private.personal_data(docs).collect()}
    for i in range(8):
        t = rows[200 + i][1]
        at = t.index("Zanzibarski")
        assert f"term:{at}:{at + 11}" in got[1000 + i]["spans"].split(",")
    assert got[2000]["n_term"] == 0 and sum(got[i]["n_term"] for i in range(200)) == 0
    clean = {r["doc_id"]: r["text"] for r in private.sanitise(docs).collect()}
    assert "[term]" in clean[1003] and "[email]" in clean[1003] and "zb.desk" not in clean[1003] and clean[5] == rows[5][1]


def test_disclosing_terms_by_plain_counts(spark):
    """Spans of terms against counts made by loops over words, contexts and entities."""
    rnd = random.Random(15)
    few = [f"word{k}" for k in range(30)]
    people = [(f"p{k}@mail.example.org", f"secret{k}") for k in range(6)]
    rows = []
    for i in range(160):
        w = [rnd.choice(few) for _ in range(rnd.randint(5, 25))]
        for _ in range(rnd.randint(0, 2)):
            mail, term = rnd.choice(people)
            at = rnd.randrange(len(w) + 1)
            w[at:at] = [term.capitalize() if rnd.random() < 0.8 else "other", mail, rnd.choice(few)]
        if rnd.random() < 0.2:
            w.append(rnd.choice(people)[1] + ",")
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[3][1]) for i in range(5)]  # copies are one context
    how = private.Disclosure(everywhere=True)
    strip = lambda w: w.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~").lower()
    total, near, pair, contexts = Counter(), Counter(), Counter(), defaultdict(set)
    for _, t in rows:
        total.update(strip(m[0]) for m in re.finditer(r"[^\x20\x09-\x0D]+", t))
        base = base_of(t)
        for s, _, e, kind in base:
            lo, hi = max(0, s - how.reach), e + how.reach
            inside = [m for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if (m.start() > lo or lo == 0) and m.start() >= lo and (m.end() < hi or m.end() == len(t)) and m.end() <= hi]
            inside = [m for m in inside if not any(a < m.end() and m.start() < z for a, _, z, _ in base)]
            where = (t[lo:s], t[e:hi])
            for m in inside:
                if len(strip(m[0])) >= how.letters:
                    pair[strip(m[0]), t[s:e]] += 1
                    near[t[s:e]] += 1
                    contexts[strip(m[0]), t[s:e]].add(where)
    n = sum(total.values())
    telling = {x for (x, e), c in pair.items() if len(contexts[x, e]) >= how.contexts and math.log2(c * n / (total[x] * near[e])) >= -how.ratio * math.log2(near[e] / n)}
    assert telling and telling < {f"secret{k}" for k in range(6)} | {"other", *few}
    got = {r["doc_id"]: r["spans"] for r in private.personal_data(spark.createDataFrame(rows, "doc_id long, text string"), how).collect()}
    for i, t in rows:
        want = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t) if strip(m[0]) in telling]
        assert [f"term:{a}:{z}" for a, z in want] == [x for x in got[i].split(",") if x.startswith("term")]


def test_many_matches_in_one_text(spark):
    text = "a@b.c " * 700 + "x" + " 1.2.3.4" * 300
    row = private.personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    want = ",".join(f"{n}:{a}:{z}" for a, _, z, n in base_of(text))
    assert row["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and (row["n_email"], row["n_ip"]) == (700, 300)


def test_disclosing_terms_at_all_places(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(i, prose(80, rnd)) for i in range(200)]
    rows += [(1000 + i, f"{'Zanzibarski. ' if i == 3 else ''}{prose(40, rnd)} the Zanzibarski desk {rnd.choice(VOCAB)} uses zb.desk@corp.example.com {rnd.choice(VOCAB)} {prose(30, rnd)}") for i in range(8)]
    rows += [(2000, prose(40, rnd) + " Zanzibarski elsewhere"), (2001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op2_pii(spark, str(tmp_path)).collect()}
    for i, t in rows[200:-1]:
        want = {f"term:{m.start()}:{m.end()}" for m in re.finditer(r"Zanzibarski\.?", t)}
        assert want and want <= set(got[i]["spans"].split(","))
    assert sum(got[i]["n_term"] for i in range(200)) == 0 and got[2001]["n_term"] == 0
    clean = [r["text"] for r in private.sanitise(docs, private.Disclosure(everywhere=True)).collect()]
    assert not any("Zanzibarski" in (t or "") for t in clean)



# ---------------------------------------------------------------- language model


def test_scores(docs, corpus):
    got = {r["doc_id"]: r for r in language.score(docs, language.Model(head=50, own=10, states=3, rounds=4)).collect()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in corpus}
    count = Counter(w for i, t, _ in corpus if not out[i] for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    for i, t, _ in corpus:
        seq, r = [*words(t), None], got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(seq), sum(count[w] > 0 for w in seq), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in seq), rel_tol=1e-9)
        assert math.isfinite(r["score"])


def test_scores_are_probabilities(docs, corpus, monkeypatch):
    kept = {}

    def train(coded, model, share, fit=language.train):
        kept["hmm"], kept["share"] = fit(coded, model, share), share
        return kept["hmm"]

    monkeypatch.setattr(language, "train", train)
    how = language.Model(head=40, own=12, states=3, rounds=3)
    got = {r["doc_id"]: r["score"] for r in language.score(docs, how).collect()}
    count = Counter(w for i, t, _ in corpus if zlib.crc32(str(i).encode()) % 10 for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    p = lambda w: (count[w] + 0.1) / (n + 0.1 * (v + 1))
    own = sorted((w for w in count if w), key=lambda w: (-count[w], w))[:12]
    kind = lambda w: language.END if w is None else own.index(w) if w in own else language.class_of(w)
    mass = Counter()
    for w in count:
        mass[kind(w)] += p(w)
    for c in range(256):  # a class's words and one unseen word have no more than the class
        unseen = p(b"never seen") if language.BYTES <= c < language.END else 0
        assert mass[c] + unseen <= kept["share"][c] * (1 + 1e-9)
        assert not mass[c] or math.isclose(mass[c] + unseen, kept["share"][c])
    hmm = kept["hmm"]
    assert np.allclose(hmm.emit.sum(1), 1) and np.allclose(hmm.move.sum(1), 1) and math.isclose(hmm.start.sum(), 1)
    for i, t, _ in corpus[::7]:  # the forward recursion over words
        a, total = hmm.start, 0.0
        for k, w in enumerate([*words(t), None]):
            a = (a if k == 0 else a @ hmm.move) * hmm.emit[:, kind(w)] * p(w) / kept["share"][kind(w)]
            total, a = total + math.log10(a.sum()), a / a.sum()
        assert math.isclose(got[i], total, rel_tol=1e-6)


def test_workers_get_small_batches(spark):
    """Batches to Python workers are of a few megabytes, however long the texts."""
    import pyarrow as pa

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    texts = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("x"), 2000).alias("text"))
    got = [r["n"] for r in common.materialise(texts.mapInArrow(common.lean(sizes), "n long"), "sizes").collect()]
    assert sum(got) >= 9000 * 2000 and max(got) < 6 << 20


def test_rows_of_word_places_are_small(spark):
    """A block of many texts is written in rows of bounded size that hold every text once, in order."""
    rnd = random.Random(94)
    docs = spark.createDataFrame([(i, " ".join(rnd.choices(VOCAB, k=3000)), i % 10 == 0) for i in range(200)], "doc_id long, text string, held_out boolean").coalesce(1)
    rows = word_model.blocks(docs, 1).where("bucket < 0").orderBy(F.desc("bucket")).collect()
    assert len({r["block"] for r in rows}) == 1 and [r["bucket"] for r in rows] == [-1 - i for i in range(len(rows))]
    assert max(len(r["seq"]) for r in rows) < 1 << 20 < sum(len(r["seq"]) for r in rows)
    assert [i for r in rows for i in r["doc_ids"]] == list(range(200)) and {n for r in rows for n in r["sizes"]} == {3000}
    assert all(len(r["seq"]) == 4 * sum(r["sizes"]) for r in rows)


def test_large_rows_are_written_and_read_a_few_at_a_time(spark):
    """Tables with rows of 100 kB and more have small row groups; a block's cells of emissions stay under half a megabyte."""
    import glob

    import pyarrow.parquet as pq

    wide = common.materialise(spark.range(0, 120, 1, 1).select("id", F.repeat(F.lit("x"), 100_000).alias("text")), "wide", large=True)
    (file,) = glob.glob(f"{wide._tessera_path.removeprefix('file:')}/*.parquet")
    meta = pq.ParquetFile(file).metadata
    assert max(meta.row_group(i).num_rows for i in range(meta.num_row_groups)) <= 32 and wide.count() == 120
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(3000)), False) for i in range(30)], "doc_id long, text string, held_out boolean").coalesce(1)
    cells = word_model.blocks(docs, word_model.BITS).where("bucket >= 0").collect()
    assert sum(len(r["hashes"]) for r in cells) == 8 * 90_000 and max(len(r["hashes"]) for r in cells) * 4 < 1 << 19


def test_states_emit_words(docs, corpus, monkeypatch):
    """The query's model against Baum-Welch and the forward recursion over words by plain loops; words that end alike have emissions of their own."""
    for block in (1 << 30, 3000):  # one block a partition, or several, so that words meet
        monkeypatch.setattr(word_model, "BLOCK_BYTES", block)
        monkeypatch.setattr(word_model, "BUCKET_BYTES", 4000)
        got = {r["doc_id"]: r for r in word_model.score(docs, language.Model(states=2, rounds=2, segment=16)).collect()}
        assert len(got) == len(corpus)
        out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _, _ in corpus}
        seqs = {i: [*words(t), None] for i, t, _ in corpus}
        count = Counter(w for i, s in seqs.items() if not out[i] for w in s)
        n, v = sum(count.values()), len(count)
        per, extra = n + 0.1 * (v + 1), 0.1 * (v + 1)
        p = lambda w: (count[w] + 0.1) / per
        kinds = [None, *(w for w in count if w), b"never seen"]
        hashes = common.byte_hashes(np.frombuffer(b"".join(kinds[1:-1]), np.uint8), np.arange(sum(map(len, kinds[1:-1]))), np.array([len(w) for w in kinds[1:-1]]))
        emit = np.ones((len(kinds), 2))
        emit[1:-1] = np.stack([0.5 + (common.mix(hashes + np.uint64(s + 1)) >> np.uint64(11)) / 2.0**53 for s in range(2)], 1)
        emit *= np.array([[p(w)] for w in kinds])
        emit /= emit.sum(0)
        at = {w: i for i, w in enumerate(kinds)}
        start, move = np.full(2, 0.5), np.array([[0.85, 0.15], [0.15, 0.85]])
        for _ in range(2):
            a0, moves, seen = np.zeros(2), np.zeros((2, 2)), np.zeros_like(emit)
            for i, s in seqs.items():
                for k in range(0, 0 if out[i] else len(s), 16):
                    x = [at[w] for w in s[k : k + 16]]
                    alpha, beta = [start * emit[x[0]]], [np.ones(2)]
                    for y in x[1:]:
                        alpha.append(alpha[-1] @ move * emit[y])
                    for y in x[:0:-1]:
                        beta.insert(0, move @ (emit[y] * beta[0]))
                    whole = alpha[-1].sum()
                    a0 += alpha[0] * beta[0] / whole
                    for j, y in enumerate(x):
                        seen[y] += alpha[j] * beta[j] / whole
                        if j:
                            moves += np.outer(alpha[j - 1], emit[y] * beta[j]) * move / whole
            start, move = (a0 + 1e-3) / (a0 + 1e-3).sum(), (moves + 1e-3) / (moves + 1e-3).sum(1, keepdims=True)
            emit = (seen + extra * np.array([[p(w)] for w in kinds])) / (seen.sum(0) + extra)
            assert np.allclose(emit.sum(0), 1)
        for i, s in seqs.items():
            a, total = start, 0.0
            for j, w in enumerate(s):
                a = (a if j == 0 else a @ move) * emit[at.get(w, len(kinds) - 1)]
                total, a = total + math.log10(a.sum()), a / a.sum()
            assert math.isclose(got[i]["score"], total, rel_tol=1e-5)
            assert (got[i]["held_out"], got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (out[i], len(s), sum(count[w] > 0 for w in s), n)
            assert math.isclose(got[i]["base_score"], sum(math.log10(p(w)) for w in s), rel_tol=1e-9)


def test_word_model_on_odd_tables(spark, hostile):
    got = word_model.score(hostile, language.Model(rounds=1)).collect()
    old = language.score(hostile, language.Model(rounds=1)).collect()
    same = lambda rows: sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert same(got) == same(old) and all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)


def test_hidden_markov_model():
    rnd = np.random.default_rng(1)
    truth = language.Hmm(np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.full((2, 256), 1e-6))
    truth.emit[0, :3], truth.emit[1, 3:6] = 1 / 3, 1 / 3
    truth.emit /= truth.emit.sum(1, keepdims=True)
    seqs = []
    for _ in range(60):
        s, out = rnd.choice(2, p=truth.start), []
        for _ in range(rnd.integers(1, 40)):
            out.append(rnd.choice(256, p=truth.emit[s]))
            s = rnd.choice(2, p=truth.move[s])
        seqs.append(np.array(out, np.uint8))

    def plain(m, seq):  # the unscaled recursion
        a = m.start * m.emit[:, seq[0]]
        for x in seq[1:]:
            a = (a @ m.move) * m.emit[:, x]
        return math.log10(a.sum())

    assert np.allclose(language.forward(truth, seqs), [plain(truth, s) for s in seqs])
    share = np.full(256, 1 / 256)
    model, last = language.Hmm.first(2, share), -1e9
    for _ in range(12):  # each round raises the likelihood of what it is trained on
        start, move, emit = language.expected(model, seqs)
        assert math.isclose(emit.sum(), sum(map(len, seqs))) and math.isclose(move.sum(), sum(len(s) - 1 for s in seqs)) and math.isclose(start.sum(), len(seqs))
        model = language.Hmm.of_counts(start, move, emit, share * 1e-6)
        now = language.forward(model, seqs).sum()
        assert now > last - 0.5
        last = now
    assert last > language.forward(language.Hmm.first(2, share), seqs).sum() + 50


# ---------------------------------------------------------------- tokens


def test_token_counts(spark, docs, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rnd = random.Random(6)
    alphabet = "abcthe THE  \n\t'sdémñß漢字٣1234½​ 　😀!?á\x85\x1c"
    texts = [t or "" for _, t, _ in corpus] + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 50))) for _ in range(800)]
    texts += ["a" * 3000, "aaa aaaaaa", "<|endoftext|> x<|endoftext|>", "0" * 99 + "\n\n  x", "I'll they're 's"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in tokens.count_tokens(rows, "byte_bpe_50k.json", keep=["doc_id"]).collect():
        t = texts[r["doc_id"]]
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(t.encode()), n, n > 512)


# ---------------------------------------------------------------- passages


def test_repeated_passages(docs, corpus):
    seen = defaultdict(set)
    for i, t, _ in corpus:
        w = words(t)
        for k in range(len(w) - 50):
            seen[tuple(w[k : k + 51])].add(i)
    want = {i for s in seen.values() if len(s) > 1 for i in s}
    got = {r["doc_id"]: r for r in passages.repeated_passages(docs).collect()}
    assert want <= set(got)  # over 50 words: all of them
    w = {i: words(t) for i, t, _ in corpus}
    for i in got:  # what is reported shares 20 words in a row with another text at least
        own = {tuple(w[i][k : k + 20]) for k in range(len(w[i]) - 19)}
        assert any(own & {tuple(w[j][k : k + 20]) for k in range(len(w[j]) - 19)} for j in w if j != i)
    assert all(r["removed"] == "" for i, r in got.items() if r["first_docs"] == [i])
    for r in got.values():  # stretches are apart and in order
        spans = [tuple(map(int, x.split("-"))) for x in r["spans"].split(",")]
        assert all(a < z for a, z in spans) and all(x[1] < y[0] for x, y in zip(spans, spans[1:])) and spans[-1][1] <= len(w[r["doc_id"]])
        gone = [tuple(map(int, x.split("-"))) for x in r["removed"].split(",") if x]
        assert all(any(a <= x and y <= z for a, z in spans) for x, y in gone) and bool(gone) == (r["n_removed"] > 0)


def test_repeats_within_one_text(spark):
    rnd = random.Random(77)
    passage, rest = prose(60, rnd).split(), [prose(70, rnd).split() for _ in range(3)]
    text = " ".join(rest[0] + passage + rest[1] + passage + rest[2])
    docs = spark.createDataFrame([(1, text), (2, prose(300, rnd)), (3, "a " * 500), (4, "five words stand here twice"), (5, "Five words stand HERE twice")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in passages.repeated_passages(docs).collect()}
    assert set(got) == {1, 3, 5, 4} and got[4]["removed"] == "" and got[5]["removed"] == "0-5"
    first = (len(rest[0]), len(rest[0]) + 60)
    second = (first[1] + len(rest[1]), first[1] + len(rest[1]) + 60)
    inside = lambda x, y: y[0] <= x[0] and x[1] <= y[1]
    spans = [tuple(map(int, x.split("-"))) for x in got[1]["spans"].split(",")]
    gone = [tuple(map(int, x.split("-"))) for x in got[1]["removed"].split(",")]
    assert any(inside(x, first) for x in spans) and gone and all(inside(x, second) for x in gone) and sum(b - a for a, b in gone) >= 32


def test_similar_paragraphs_against_all_pairs(spark):
    rnd, how = random.Random(31), passages.Passages()
    texts = []
    for _ in range(14):
        base = [rnd.choice(VOCAB) for _ in range(300)]
        for _ in range(16):
            w = list(base)
            for _ in range(rnd.randint(1, 9)):
                w[rnd.randrange(300)] = rnd.choice(VOCAB) + "y"
            texts.append(" ".join(w[rnd.randrange(40) :]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    windows = passages.paragraphs(docs, how).cache()
    rows = windows.where("size(keys) > 0").collect()
    covered = defaultdict(int)
    sets = {}
    for r in rows:
        covered[r["doc_id"]] += r["n"]
        sets[r["f1"], r["f2"]] = shingles(" ".join(texts[r["doc_id"]].split()[r["pos"] : r["pos"] + r["n"]]))
    assert {i: len(t.split()) for i, t in enumerate(texts)} == covered  # paragraphs cover texts
    assert len({frozenset(s) for s in sets.values()}) == len(sets)
    ids = sorted(sets)
    alike = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    classes, links, comp = passages.similar_classes(windows, docs, how)
    name = {r["id"]: (r["f1"], r["f2"]) for r in classes.collect()}
    links = [tuple(sorted((name[r["a"]], name[r["b"]]))) for r in links.collect()]
    assert len(alike) > 300 and set(links) <= set(alike)
    found = groups(ids, links)
    parts = {name[r["node"]]: name[r["component"]] for r in comp.collect()}
    assert set(parts) == {x for e in links for x in e} and all((parts[a] == parts[b]) == (found[a] == found[b]) for a in parts for b in parts)
    assert sum(found[a] == found[b] for a, b in alike) >= 0.98 * len(alike)
    keys = {(r["f1"], r["f2"]): set(r["keys"]) for r in rows}
    meet = [(a, b) for a, b in alike if keys[a] & keys[b]]
    assert len(meet) >= 0.95 * len(alike) and all(found[a] == found[b] for a, b in meet)  # of classes that share a key no link is lost


# ---------------------------------------------------------------- licences


def test_licenses(spark):
    mit = licenses.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2001 Someone\n\n" + mit.upper().replace("\n", "\n\n")), (2, "text\nLicenced under the Apache Licence; version 2.0\nmore"), (3, "Licensed under the MIT License, or not."), (4, None), (5, "")]
    got = sorted(map(tuple, licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(1, -1, "MIT"), (2, 1, "Apache-2.0")]


def test_whole_license_texts_and_own_table(spark):
    texts = licenses.full_texts()
    docs = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)] + [(99, "Our own terms hold.")], "doc_id long, text string")
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(docs).where("line_no = -1").collect()}
    assert got == {(i, n) for i, (n, _) in enumerate(texts)}
    assert [tuple(r) for r in licenses.scan(docs, [("own", "our own terms hold")]).collect() if r["line_no"] < 0] == [(99, -1, "own")]



# ---------------------------------------------------------------- benchmark


def test_leaks(spark, docs, corpus):
    rnd = random.Random(12)
    items = [(i, prose(rnd.randint(18, 55), rnd)) for i in range(30)] + [(90, ""), (91, None), (92, "too short")]
    rows, want = [(i, t) for i, t, _ in corpus], set()
    for i, t in items[:24]:
        w = t.split(" ")
        for k, drop in enumerate((0.0, 0.0, 0.12)):  # verbatim, in capitals, and with other words
            inside = " ".join(rnd.choice(VOCAB) if rnd.random() < drop else x for x in w)
            host = prose(120, rnd).split(" ")
            at = rnd.randrange(len(host))
            doc = 5000 + 10 * i + k
            rows.append((doc, " ".join(host[:at] + (inside.upper() if k == 1 else inside).split(" ") + host[at:])))
            want.add((doc, i))
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert not got - want and len(got & want) >= 0.9 * len(want)
    assert {x for x in want if x[0] % 10 < 2 and len(dict(items)[x[1]].split()) > 20} <= got


def test_leaks_as_paraphrases(spark):
    """Words have synonyms that stand in for each other all over the corpus; items come back with
    synonyms and their clauses turned round.  Retrieval is held against checking every window."""
    rnd = random.Random(63)
    topics = [[(f"t{t}w{k}a", f"t{t}w{k}b") for k in range(40)] for t in range(25)]
    common = [f"c{k}" for k in range(40)]

    def text(t, n):
        return [rnd.choice(common) if rnd.random() < 0.4 else rnd.choice(rnd.choice(topics[t])) for _ in range(n)]

    items, rows = [], [(i, " ".join(text(rnd.randrange(25), 90))) for i in range(700)]
    for i in range(40):
        t = rnd.randrange(25)
        w = text(t, rnd.randint(24, 50))
        items.append((i, " ".join(w)))
        other = {a: b for x, y in topics[t] for a, b in ((x, y), (y, x))}
        for k, (swapped, turned) in enumerate(((0.0, 0), (0.15, 0), (0.3, 0), (0.1, 6), (0.2, 4))):
            new = [other.get(x, x) if rnd.random() < swapped else x for x in w]
            new = new[turned:] + new[:turned]
            host = text(rnd.randrange(25), 100)
            rows.append((10_000 + 10 * i + k, " ".join(host[:40] + new + host[40:])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r[0], r[1]) for r in leaks.find_leaks(docs, benchmark).collect()}
    full = {(r[0], r[1]) for r in leaks.find_leaks(docs, benchmark, leaks.Leaks(cosine=-1e9, held=-1e9)).collect()}
    assert got <= full and len(got) >= 0.9 * len(full)
    assert {(10_000 + 10 * i, i) for i in range(40)} <= got and len(full) > 120


def test_latent_space_learns_from_the_corpus(spark, monkeypatch):
    """Two words that share contexts in the corpus only lie together; the benchmark has one of them."""
    rnd = random.Random(8)
    pairs = [(f"left{k}", f"right{k}", [f"ctx{k}x{j}" for j in range(6)]) for k in range(12)]
    rows = [(i, " ".join([rnd.choice(pairs[i % 12][:2]) if j % 4 == 0 else rnd.choice(pairs[i % 12][2]) for j in range(40)])) for i in range(600)]
    kept = {}

    def latent(passages, size, columns, weights, word, how, fit=leaks.latent):
        kept["v"], kept["columns"] = fit(passages, size, columns, weights, word, how), columns
        return kept["v"]

    monkeypatch.setattr(leaks, "latent", latent)
    items = [(k, f"left{k} is what the question number {k} asks for here") for k in range(12)]
    leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), leaks.Leaks(dims=14, over=8)).count()
    known = np.unique(leaks.hashed([t.encode() for _, t in items])[0])
    of = lambda w: kept["v"][kept["columns"][leaks.numbered(leaks.hashed([w.encode()])[0], known, leaks.Leaks().buckets)[0]]]
    cos = lambda a, b: float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b) + 1e-12))
    same = [cos(of(a), of(b)) for a, b, _ in pairs]
    other = [cos(of(pairs[k][0]), of(pairs[(k + 5) % 12][1])) for k in range(12)]
    assert np.median(same) > 0.3 + np.median(other)


def test_latent_space_counts_every_window(spark, monkeypatch):
    """Products of the passages, however they are cut and numbered, against one dense matrix of all of them."""
    kept = {}

    def product(passages, rows, width, make, add=leaks._product):
        kept["products"] = [*kept.get("products", []), add(passages, rows, width, make)]
        return kept["products"][-1]

    def latent(passages, size, columns, weights, word, how, fit=leaks.latent):
        kept["args"], kept["passages"] = (size, columns, weights, word), passages.collect()
        return fit(passages, size, columns, weights, word, how)

    monkeypatch.setattr(leaks, "_product", product)
    monkeypatch.setattr(leaks, "latent", latent)
    monkeypatch.setattr(leaks, "HOT", 7)
    monkeypatch.setattr(leaks, "STEP", 5)
    rnd = random.Random(91)
    docs = [(i, " ".join(rnd.choice(VOCAB) for _ in range(rnd.choice([0, 1, 31, 32, 33, 90, 400])))) for i in range(300)]
    items = [(i, prose(rnd.randint(20, 150), rnd)) for i in range(12)]
    how = leaks.Leaks(dims=10, over=4, buckets=16, features=9)  # several words of the benchmark share a column
    leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string"), how).count()
    size, columns, weights, word = kept["args"]
    rows, of_docs = [], 0
    for r in kept["passages"]:
        ids = np.frombuffer(r["ids"], word)
        of_docs += len(ids) * (r["scale"] == 1.0)
        for at in range(0, len(ids), r["cut"]):
            row, w = np.zeros(size), weights[ids[at : at + r["cut"]]].astype(float)
            np.add.at(row, columns[ids[at : at + r["cut"]]], w * r["scale"] / np.linalg.norm(w))
            rows.append(row)
    assert of_docs == sum(len(t.split()) for _, t in docs)  # no document is left out
    a, q = np.array(rows), np.random.default_rng(11).standard_normal((size, 14))
    assert np.allclose(kept["products"][0], a.T @ (a @ q), rtol=1e-4, atol=1e-4 * np.abs(kept["products"][0]).max())


def test_latent_space_by_pairs_and_by_passages(spark, monkeypatch):
    """Sums of all pairs, made once, and products that read all passages each give the same matrix: both are held against a dense one."""
    rnd = random.Random(92)
    columns, weights = np.array([0, 1, 2, 3, 4, 0, 1, 5, 6, 7, 8]), np.linspace(0.05, 3, 11).astype(np.float32)
    texts = [np.array([rnd.choice([0, 0, 0, *range(11)]) for _ in range(rnd.choice([1, 7, 8, 9, 60]))], np.uint16) for _ in range(80)]
    table = spark.createDataFrame([(bytearray(x.tobytes()), rnd.choice([1.0, 5.0]), rnd.choice([8, 16])) for x in texts], "ids binary, scale double, cut int").repartition(3).cache()
    a = []
    for r in table.collect():
        ids = np.frombuffer(r["ids"], np.uint16)
        for at in range(0, len(ids), r["cut"]):
            row, w = np.zeros(9), weights[ids[at : at + r["cut"]]].astype(float)
            np.add.at(row, columns[ids[at : at + r["cut"]]], w * r["scale"] / np.linalg.norm(w))
            a.append(row)
    whole, reads, made = np.array(a).T @ np.array(a), [], leaks._product

    def product(passages, rows, width, make):
        reads.append(passages.columns)
        return made(passages, rows, width, make)

    monkeypatch.setattr(leaks, "_product", product)
    monkeypatch.setattr(leaks, "PAIR_SLAB", 7)
    monkeypatch.setattr(leaks, "HOT_PAIRS", 10)
    how = leaks.Leaks(dims=9, over=0, buckets=4, features=5)
    for most, read in ((1 << 25, ["slab", "sums"]), (0, ["ids", "scale", "cut"])):
        monkeypatch.setattr(leaks, "PAIRS", most)
        reads.clear()
        v = leaks.latent(table, 9, columns, weights, np.uint16, how)
        assert reads == [read] * 3  # the passages are read once, or three times
        values = np.diag(v.T @ whole @ v)
        assert np.allclose((v * values) @ v.T, whole, rtol=1e-4, atol=1e-4 * whole.max())


def test_windows_near_every_passage_take_little_memory(monkeypatch):
    """Stretches of near windows against plain loops; where all windows are near all passages, no matrix of all of them is made."""
    import tracemalloc

    rnd = np.random.default_rng(93)
    of, owner = np.sort(rnd.integers(0, 9, 120)), rnd.integers(0, 5, 23)
    owner[:5] = range(5)
    windows, queries = rnd.standard_normal((120, 6)).astype(np.float32), rnd.standard_normal((23, 6)).astype(np.float32)
    lengths, enough = rnd.uniform(1, 6, 120).astype(np.float32), rnd.uniform(1, 6, 23).astype(np.float32)
    hits = sorted({(int(of[w]), int(owner[q]), w) for w in range(120) for q in range(23) if windows[w] @ queries[q] >= min(lengths[w], enough[q])})
    want = []
    for d, i, w in hits:
        if want and want[-1][:2] == [d, i] and w <= want[-1][3] + 2:
            want[-1][3] = w
        else:
            want.append([d, i, w, w])
    monkeypatch.setattr(leaks, "WINDOWS", 7)
    monkeypatch.setattr(leaks, "QUERIES", 4)
    assert [list(x) for x in zip(*map(np.ndarray.tolist, leaks.near_stretches(windows, lengths, queries, enough, owner, of)), strict=True)] == want
    monkeypatch.undo()

    of, owner = np.repeat(np.arange(64), 128), np.arange(1000)
    tracemalloc.start()
    d, i, a, z = leaks.near_stretches(np.ones((8192, 6), np.float32), np.ones(8192, np.float32), np.ones((1000, 6), np.float32), np.ones(1000, np.float32), owner, of)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(d) == 64 * 1000 and (z - a == 127).all()
    assert peak < 100 << 20  # the matrix of all pairs and their numbers take over 500 MB


def test_short_items_stand_alone(spark):
    items = spark.createDataFrame([(1, "Yes."), (2, "The river Po!"), (3, "of it all"), (4, "..."), (5, "yes")], "item_id long, text string")
    rows = [(1, "yes"), (2, "so the river po runs"), (3, "a line\n  The RIVER, Po\nmore"), (4, ""), (5, None), (6, "of it\nall"), (None, "YES"), (7, "...")]
    got = {(r[0], r[1], r[2]) for r in leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 1, 1.0), (1, 5, 1.0), (3, 2, 1.0), (6, 3, 1.0), (None, 1, 1.0), (None, 5, 1.0)}


def test_leaks_of_common_words_and_of_long_items(spark):
    rnd = random.Random(41)
    rare = lambda n: ["".join(rnd.choice("bcdfghjklm") for _ in range(9)) for _ in range(n)]
    items = [(1, " ".join(rnd.sample(VOCAB, 9))), (2, " ".join(rnd.sample(VOCAB, 300)))]
    rows, want = [], set()
    for doc in range(240):
        host = rare(100)
        if item := 1 if doc % 3 == 0 else 2 if doc % 40 == 1 else 0:
            at = rnd.randrange(100)
            host[at:at] = dict(items)[item].split()
            want.add((doc, item))
        rows.append((doc, " ".join(host)))
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want



# ---------------------------------------------------------------- mixing


def test_van_der_corput_counts(spark):
    points = [int(format(i, f"0{mixing.BITS}b")[::-1], 2) for i in range(500)]
    rnd = random.Random(3)
    cases = [(n, x, sum(p < x for p in points[:n])) for n, x in ((rnd.randint(0, 500), rnd.randint(0, 1 << mixing.BITS)) for _ in range(80))]
    assert all(mixing.count_below(n, x) == c for n, x, c in cases)
    frame = spark.createDataFrame(cases, "n long, x long, want long").withColumn("got", mixing.below("n", "x"))
    assert frame.where("got <> want").count() == 0


def test_mixing(docs, corpus):
    got = mixing.mix_documents(docs).collect()
    size = defaultdict(int)
    for _, t, s in corpus:
        size[s] += len((t or "").encode().split())
    order = sorted((s for s in size if s is not None), key=str.encode) + [None]
    want = dict(zip(order, mixing.targets([size[s] for s in order], [1 + i % 3 for i in range(len(order))], 3), strict=True))
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == size[r["source"]] and math.isclose(r["target"], want[r["source"]]) and 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in order) and len(got) == len(corpus)
    assert sorted(map(tuple, mixing.mix_documents(docs.repartition(3)).collect()), key=repr) == sorted(map(tuple, got), key=repr)


def test_mixing_with_many_sources(docs, monkeypatch):
    """The schedule is the same where the sources' table does not go to every task."""
    few = sorted(map(tuple, mixing.mix_documents(docs).collect()), key=repr)
    monkeypatch.setattr(mixing, "FEW", 0)
    assert sorted(map(tuple, mixing.mix_documents(docs).collect()), key=repr) == few


def test_targets():
    assert mixing.targets([10, 100, 1000], [1, 2, 3], 3) == [30, 300, 780]
    assert mixing.targets([0, 0], [1, 2], 3) == [0, 0] and mixing.targets([], [], 3) == []


# ---------------------------------------------------------------- quality


def test_quality(docs, corpus):
    got = {r["doc_id"]: r for r in quality.assess(docs, keep=["doc_id"]).select("doc_id", "quality.*").collect()}
    extra = "same words here again and again " * 9
    rows = [*((i, t) for i, t, _ in corpus), (9001, extra), (9002, prose(60) + " # $ % & | < > *" * 20), (9003, "a line here\n" * 30 + prose(60))]
    got |= {r["doc_id"]: r for r in quality.assess(docs.sparkSession.createDataFrame(rows[-3:], "doc_id long, text string"), keep=["doc_id"]).select("doc_id", "quality.*").collect()}
    for i, t in rows:
        w, r = (t or "").encode().split(), got[i]
        tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        repeat = sum(any(tri[tuple(w[a : a + 3])] > 1 for a in range(max(0, k - 2), min(k, len(w) - 3) + 1)) for k in range(len(w)))
        seen, dup = set(), 0
        for x in (t or "").split("\n"):
            if x.encode().split():
                dup += x in seen
                seen.add(x)
        failed = len(w) < 50 or 100 * repeat > 50 * len(w)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t or "")), dup, repeat, failed)
        assert r["kept"] is False if failed else r["kept"] == (i not in (9001, 9002, 9003))


def test_coverage_of_ngrams():
    rnd = random.Random(19)
    for _ in range(400):
        w = [rnd.choice("abcde") * rnd.randint(1, 3) + rnd.choice(["", "é"]) for _ in range(rnd.randint(0, 60))]
        if rnd.random() < 0.5 and len(w) > 12:
            a = rnd.randrange(len(w) - 11)
            w += w[a : a + rnd.randint(4, 12)]
        got = quality.measure(" ".join(w).encode())
        for k, n in enumerate((5, 7, 10)):
            seen = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
            covered = {i + j for i in range(len(w) - n + 1) if seen[tuple(w[i : i + n])] > 1 for j in range(n)}
            assert got[6 + k] == sum(len(w[i]) for i in covered)


# ---------------------------------------------------------------- hostile tables

LONG = " ".join(RND.choice(VOCAB) for _ in range(4000))
HOSTILE = [(None, None, None), (None, "", "s"), (None, "a b c d e f g h i", None), (1, "", ""), (1, "", ""), (2, LONG, "s"), (2, LONG, "s"), (3, LONG + "\n" + LONG, "s"), (4, "x" * 50_000, None), (5, "\n\n\n", "t"), (-6, "😀 é  \x00 ß", "t"), (7, "a a a a a a a a a a a a", "t"), (7, "another text under the same id, of ten words, or so", "t")]
CLASH = "doc_id long, text string, source string, n_words long, quality string, rk string, rk_ string, taken long, row long, gone_ long, fp long, base string, bucket_ long, text_ string"


@pytest.fixture(scope="module", params=["rows", "none"])
def hostile(request, spark):
    rows = [(*r, 1, "q", "r", "r", 2, 3, 4, 5, "b", 6, "t") for r in HOSTILE] if request.param == "rows" else []
    return spark.createDataFrame(rows, CLASH)


def test_hostile_tables(spark, hostile):
    n = hostile.count()
    items = spark.createDataFrame([(1, " ".join(LONG.split(" ")[50:90])), (2, None)], "item_id long, text string")
    assert quality.assess(hostile).count() == n and quality.assess(hostile).columns[-1] == "_quality"
    assert tokens.count_tokens(hostile, "byte_bpe_50k.json", names=("nb", "nt", "o")).count() == n
    assert mixing.mix_documents(hostile).count() == n
    mixed = mixing.mixed_corpus(hostile)
    assert mixed.columns == [*hostile.columns, "size", "source_size", "target", "_taken", "slots"] and mixed.count() == mixing.mix_documents(hostile).where("taken > 0").count()
    assert private.personal_data(hostile).count() == n and private.sanitise(hostile).columns == hostile.columns
    assert language.score(hostile, language.Model(rounds=1)).count() == n
    report = lines.line_report(hostile).collect()
    assert len(report) == n
    assert lines.dedup_lines(hostile).columns == hostile.columns and lines.dedup_lines(hostile).count() <= n
    found = near.near_duplicates(hostile).collect()
    assert len(found) == n and all(r["kept"] for r in found if r["doc_id"] is None)
    assert near.drop_near_duplicates(hostile).count() == sum(r["kept"] for r in found)
    again = {r["doc_id"]: r["n_removed"] > 0 for r in passages.repeated_passages(hostile).collect()}
    assert again == ({2: False, 3: True, 7: True} if n else {}) or again == ({2: False, 3: True} if n else {})
    assert licenses.scan(hostile).count() == 0
    hits = {(r[0], r[1]) for r in leaks.find_leaks(hostile, items).collect()}
    assert hits == ({(2, 1), (3, 1)} if n else set())
    assert leaks.drop_leaks(hostile, items).count() == (n - 3 if n else 0)
    assert leaks.find_leaks(hostile, items.where("item_id > 9")).count() == 0


def test_megabyte_texts(spark):
    rnd = random.Random(3)
    huge = " ".join(rnd.choice(VOCAB) for _ in range(200_000))
    item = " ".join(huge.split(" ")[150_000:150_040])
    lines_of = "\n".join(" ".join(rnd.choice(VOCAB) for _ in range(9)) for _ in range(20_000))
    rows = [(1, huge, "a"), (2, huge, "a"), (3, "a" * 1_500_000, "b"), (4, lines_of, "b"), (5, "a " * 400_000, "c"), (6, prose(80), "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).cache()
    assert {r["doc_id"]: r["n_words"] for r in quality.assess(docs, keep=["doc_id"]).select("doc_id", "quality.*").collect()} == {i: len(t.split()) for i, t, _ in rows}
    removed = {r["doc_id"]: r["n_removed"] for r in lines.line_report(docs).collect()}
    assert removed[2] == 1 and removed[1] == removed[3] == removed[6] == 0
    assert {r["doc_id"] for r in near.near_duplicates(docs).where("not kept").collect()} == {2}
    again = {r["doc_id"]: r["removed"] for r in passages.repeated_passages(docs).collect()}
    assert again[1] == "" and again[2] == "0-200000" and 6 not in again
    assert {(r[0], r[1]) for r in leaks.find_leaks(docs, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()} == {(1, 9), (2, 9)}
    assert private.personal_data(docs).count() == 6 and licenses.scan(docs).count() == 0
    assert sum(r["taken"] for r in mixing.mix_documents(docs).collect()) > 0
    assert all(math.isfinite(r["score"]) for r in language.score(docs, language.Model(rounds=1)).collect())
    assert {r["doc_id"]: r["n_bytes"] for r in tokens.count_tokens(docs.where("doc_id in (4, 6)"), "byte_bpe_50k.json", keep=["doc_id"]).collect()} == {i: len(t.encode()) for i, t, _ in rows if i in (4, 6)}


def test_mixed_corpus_by_its_slots(spark, docs, corpus):
    rows = mixing.mixed_corpus(docs.withColumn("taken", F.lit("mine"))).collect()
    texts = {i: (t or "").split() for i, t, _ in corpus}
    assert rows and all(r["taken"] == "mine" and r["text"] is not None for r in rows)
    facts = {r["doc_id"]: r["taken"] for r in mixing.mix_documents(docs).collect()}
    assert {r["doc_id"]: r["_taken"] for r in rows} == {i: n for i, n in facts.items() if n}
    pieces = sorted((s["slot"], r["source"] or "", r["target"], s["to_word"] - s["from_word"], r["doc_id"], s["from_word"], s["to_word"]) for r in rows for s in r["slots"])
    assert all(0 <= a < z <= len(texts[i]) for *_, i, a, z in pieces)
    targets = {s: t for _, s, t, *_ in pieces}
    whole, taken = sum(targets.values()), Counter()
    for slot, s, _, n, *_ in pieces:  # every long enough prefix of the schedule is near the targets
        taken[s] += n
        if sum(taken.values()) > 0.3 * whole:
            assert all(abs(taken[k] / sum(taken.values()) - t / whole) < 0.08 for k, t in targets.items())


def test_free_name():
    assert free_name(["Quality", "_quality"], "quality") == "__quality"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    cursor = con.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    got = queries.QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(got.columns)
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*columns).collect())
