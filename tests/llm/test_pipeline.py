"""The pipeline's stages, each against a brute-force version on a small table with all kinds of documents."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
RND = random.Random(23)
VOCAB = ["".join(RND.choice("abcdefghilmnoprstu") for _ in range(RND.randint(3, 9))) for _ in range(700)]


def sentence(n, rnd):
    return " ".join(rnd.choice(VOCAB) for _ in range(n))


def words(t):
    return (t or "").encode().lower().split()


def shingles(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def table():
    """Rows (doc_id, text, lang, source, n_chars) and benchmark items."""
    rnd = random.Random(7)
    items = [(i, sentence(rnd.randint(16, 40), rnd) + ".") for i in range(6)]
    texts = ["\n".join(sentence(rnd.randint(12, 20), rnd) for _ in range(rnd.randint(5, 9))) for _ in range(40)]
    for i in range(8):  # the same words in other lines, with some edits: lines differ, documents do not
        w = texts[i].split()
        for _ in range(i % 3):
            w[rnd.randrange(len(w))] = "edited" + str(i)
        cut = rnd.randint(2, 6)
        texts.append("\n".join(" ".join(w[a : a + 7]) for a in range(cut, len(w), 7)) + "\n" + " ".join(w[:cut]))
        texts.append(" ".join(w))
    texts += texts[10:14]  # exact copies
    texts += [texts[15] + "\n" + sentence(60, rnd), texts[16].replace(" ", "  ", 3)]
    for i, t in items:  # benchmark items inside
        texts.append(sentence(50, rnd) + "\n" + sentence(20, rnd) + " " + t + " " + sentence(20, rnd))
    texts += ["same words again " * 40, "# $ % & | < >\n" * 30, "short", "", None, "one line\n" * 60, sentence(49, rnd), sentence(50, rnd)]
    return [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)], items


@pytest.fixture(scope="module")
def stages(spark, table, tmp_path_factory):
    """What goes into each stage and what comes out, as lists of rows."""
    sf = str(tmp_path_factory.mktemp("sf"))
    rows, items = table
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(f"{sf}/{k}")
        after = spark.read.parquet(f"{sf}/{k}")
        assert k == 4 or after.columns == docs.columns
        out[name] = (docs.collect(), after.collect())
        docs = after
    out["run"] = corpus_pipeline.run(spark, sf).collect(), corpus_pipeline.run(spark, sf).collect()
    return out


def test_quality_stage(stages):
    before, after = stages["quality rules"]
    kept = {r["doc_id"] for r in after}
    for r in before:
        w = words(r["text"])
        tri = Counter(zip(w, w[1:], w[2:]))
        repeat = sum(any(tri[tuple(w[a : a + 3])] > 1 for a in range(max(0, k - 2), min(k, len(w) - 3) + 1)) for k in range(len(w)))
        symbols = sum(c in "#*$%&|<>" for c in r["text"] or "")
        good = len(w) >= 50 and 100 * repeat <= 50 * len(w) and 4 * symbols <= len(w)
        assert (r["doc_id"] in kept) == good
    assert {tuple(r) for r in after} <= {tuple(r) for r in before} and len(after) < len(before)


def test_line_stage(stages):
    before, after = stages["line dedup"]

    def apart(a, b):
        if a == b:
            return True
        if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 5:
            return False
        p = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]

    seen, want = [], {}
    for r in sorted(before, key=lambda r: r["doc_id"]):
        left = []
        for line in r["text"].split("\n"):
            w = tuple(line.split())
            if not w or not any(apart(w, v) for v in seen):
                left.append(line)
            seen.append(w)
        if any(x.split() for x in left):
            want[r["doc_id"]] = "\n".join(left)
    assert {r["doc_id"]: r["text"] for r in after} == want and len(want) < len(before)


def test_near_stage_acts_after_line_dedup(stages):
    before, after = stages["near dedup"]
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    assert {r["doc_id"] for r in after} == {root(i) for i in sets} and len(after) <= len(before) - 8


def test_decontamination_stage(stages, table):
    before, after = stages["decontamination"]
    flat = lambda t: " ".join(w.strip(b".") .decode() for w in words(t))
    held = {r["doc_id"] for r in before if any(flat(t) in flat(r["text"]) for _, t in table[1])}
    assert len(held) == 6 and {r["doc_id"] for r in after} == {r["doc_id"] for r in before} - held


def test_mixing_stage(stages):
    from tessera.llm.mixing import targets

    before, after = stages["source mixing"]
    size = Counter()
    for r in before:
        size[r["source"]] += len(words(r["text"]))
    names = sorted((s for s in size if s is not None), key=str.encode) + [None] * (None in size)
    want = dict(zip(names, targets([size[s] for s in names], [1 + i % 3 for i in range(len(names))], 3), strict=True))
    taken = Counter()
    for r in after:
        taken[r["source"]] += r["taken"]
        assert 0 < r["taken"] <= 3 * len(words(r["text"])) and sum(s["to_word"] - s["from_word"] for s in r["slots"]) == r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    texts = {r["doc_id"]: (r["text"], r["lang"], r["n_chars"]) for r in before}
    assert all(texts[r["doc_id"]] == (r["text"], r["lang"], r["n_chars"]) for r in after)


def test_run_gives_the_stages_rows_twice_alike(stages):
    once, again = (sorted(map(repr, rows)) for rows in stages["run"])
    assert once == again == sorted(map(repr, stages["source mixing"][1])) and once


def test_odd_tables(spark, tmp_path):
    """No rows at all; and null ids, empty texts, repeated rows and columns that clash."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, quality string, rk string, taken long, row long, slots string, new string"
    good = sentence(60, random.Random(1))
    rows = [(i, t, "en", "s", 1, "q", "r", 2, 3, "s", "n") for i, t in ((None, good), (None, good), (1, good + " and more"), (1, good + " and more"), (2, None), (3, ""), (4, sentence(80, random.Random(2))))]
    for k, some in enumerate((rows, [])):
        sf = f"{tmp_path}/{k}"
        spark.createDataFrame(some, schema).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, sentence(20, random.Random(3)))] if some else [], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        out = corpus_pipeline.run(spark, sf)
        assert out.columns[: len(schema.split(","))] == [c.split()[0] for c in schema.split(", ")]
        assert {r["doc_id"] for r in out.collect()} == ({None, 1, 4} if some else set())  # rows without an id stand alone


@pytest.mark.parametrize("percent", [80, 85])
def test_one_of_each_group(spark, percent):
    from tessera.llm import near

    docs = spark.createDataFrame([(3, "a b c d e f g"), (1, "a b c d e f g"), (2, None), (4, "")], "doc_id long, text string")
    assert {r[0] for r in near.drop_near_duplicates(docs, near.Near(percent=percent)).collect()} == {1, 2, 4}


def test_near_stage_bands_hold_for_its_threshold(spark):
    how = corpus_pipeline.NEAR
    assert (1 - (how.percent / 100) ** how.rows) ** (how.slots // how.rows) < 0.00001
    words = [f"w{i}" for i in range(120)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:110])), (3, " ".join(words[::-1]))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_a_missing_shared_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    from tessera import tables

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda key, default=None: default)})()

    with pytest.raises(RuntimeError):
        tables.shared_folder(Session())
    assert spark.range(3).select(F.sum("id")).first()[0] == 3
