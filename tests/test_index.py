import pytest
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions import text as T
from tessera.operators import index, search


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "file_id long, text string")


def postings(spark, texts):
    return index.build_postings(frame(spark, texts))


def answers(spark, texts, request, exact=False, limit=5, normalize=True):
    requests = spark.createDataFrame([(1, request)], "request_id int, request string")
    found = search.search(postings(spark, texts), requests, EngineConfig(exact=exact, limit=limit, normalize_query=normalize))
    return [(r["file_id"], round(r["relevance"], 6)) for r in found.orderBy("rank").collect()]


def counts(spark, texts, word):
    return {r["file_id"]: r["cnt"] for r in index.word_lookup(postings(spark, texts), [word]).collect()}


def test_punctuation_at_ends(spark):
    docs = ["harbour lies (beside an  old pier", "an: otter swims past, an? angler and an heron; then an. owl calls"]
    assert counts(spark, docs, "harbour") == {0: 1} and counts(spark, docs, "an") == {0: 1, 1: 4}


def test_frequencies(spark):
    docs = ["oak elm oak oak", "elm ash elm elm elm elm", "oak " * 7 + "elm " * 2, "willow poplar"]
    assert counts(spark, docs, "oak") == {0: 3, 2: 7} and counts(spark, docs, "elm") == {0: 1, 1: 5, 2: 2} and counts(spark, docs, "poplar") == {3: 1}


def test_absent_word(spark):
    docs = ["a b c d e f g h i j k l", "statement"]
    assert counts(spark, docs, "m") == {} and counts(spark, docs, "statement") == {1: 1}


def test_any_word_ranking_and_ties(spark):
    notes = ["green lamp on the north pier", "green lamp", "a boat", "red lamp on the south pier", "nothing here", "lamp", "fog over the north bay", "green and red lamp on the north shore"]
    got = answers(spark, notes, "green lamp on the north coast")
    assert got == [(0, 1.0), (7, 1.0), (3, 0.6), (1, 0.4), (6, 0.4)]


def test_shares_of_the_best_and_a_tie_at_the_limit(spark):
    notes = ["fern " * 2, "fern " * 8, "moss", "fern", "fern " * 4, "fern " * 6, "fern"]
    assert answers(spark, notes, "fern", limit=5) == [(1, 1.0), (5, 0.75), (4, 0.5), (0, 0.25), (3, 0.125)]


@pytest.mark.parametrize("request_text", ["", "   ", "missing"])
def test_nothing_found(spark, request_text):
    assert answers(spark, ["some words here"], request_text) == []


def test_all_words(spark):
    docs = ["kiln fires clay pots kiln fires", "clay of the river", "kiln fires glaze", "pots", "fires kiln pots clay kiln fires clay and kiln fires"]
    assert [i for i, _ in answers(spark, docs, "Kiln fires CLAY pots", exact=True)] == [4, 0]
    assert answers(spark, docs, "kiln fires clay pots AbsentWord", exact=True) == []


def test_query_as_it_stands_and_repeats(spark):
    assert answers(spark, ["the cat"], "the", normalize=False) == []
    assert answers(spark, ["the cat"], "THE THE", normalize=False) == [(0, 1.0)]
    assert answers(spark, ["the cat", "the the"], "the The, THE!") == [(1, 1.0), (0, 0.5)]


def test_limit_zero_is_unlimited(spark):
    assert len(answers(spark, ["a"] * 40, "a", limit=0)) == 40


def test_batch_equals_single_searches(spark):
    docs, asked = ["a b c", "a a d", "c c c", "b"], ["a", "b c", "c d x", ""]
    requests = spark.createDataFrame(list(enumerate(asked)), "request_id int, request string")
    got = {(r["request_id"], r["file_id"], r["rank"]) for r in search.search(postings(spark, docs), requests).collect()}
    assert got == {(n, f, k + 1) for n, r in enumerate(asked) for k, (f, _) in enumerate(answers(spark, docs, r, limit=30))}


def test_edge_tokens(spark):
    rows = [("don't", ["DON'T"]), ("a,b", ["A,B"]), ('"q"', ["Q"]), ("---", []), ("a\tb\nc\x00d", ["A", "B", "C", "D"]), ("straße", ["STRAßE"]), ("ёж", ["ЁЖ"]), ("", []), (None, None)]
    got = spark.createDataFrame([(t,) for t, _ in rows], "t string").select("t", T.words(F.col("t")).alias("w")).collect()
    assert [r["w"] for r in got] == [w for _, w in rows]


def test_json_answers(spark, tmp_path):
    import json

    requests = spark.createDataFrame([(1, "a"), (2, "zzz"), (3, "a")], "request_id int, request string")
    found = search.search(postings(spark, ["a b", "a a"]), requests).withColumn("path", F.concat(F.lit('d"'), F.col("file_id").cast("string")))
    search.write_answers(search.answers(requests, found), f"{tmp_path}/a.json")
    by_number = json.loads((tmp_path / "a.json").read_text())["Answers"]
    assert by_number["request001"] == {"result": True, "relevance": [['d"1', 1.0], ['d"0', 0.5]]} and by_number["request002"] == {"result": False}
    assert {r["label"] for r in search.answers(requests, found, use_text=True).collect()} == {"a", "zzz"}
    lines = [r["line"] for r in search.text_lines(found.where("request_id = 1")).orderBy("rank").collect()]
    assert lines == ['d"1;1.000000', 'd"0;0.500000']
    changed, digest = search.request_changed("{}", None)
    assert changed and search.request_changed("{}", digest) == (False, digest)


def test_six_digits_as_c_prints_them(spark):
    import numpy as np

    values = [float(np.float32(a) / np.float32(b)) for a, b in ((1, 128), (3, 128), (1, 3), (2, 3), (1, 1), (5, 64), (7, 9), (1, 4096), (3, 2**20))]
    rows = spark.createDataFrame([(1, i, "p", v) for i, v in enumerate(values)], "request_id int, rank int, path string, relevance float")
    assert [r["line"] for r in search.text_lines(rows).orderBy("rank").collect()] == ["p;%.6f" % v for v in values]


def test_search_without_index_and_with_many_words(spark, monkeypatch):
    docs, asked = ["a b c", "a a d", "c c c", "b"], [(1, "a c"), (2, "b x"), (3, "")]
    requests = spark.createDataFrame(asked, "request_id int, request string")
    want = sorted(map(tuple, search.search(postings(spark, docs), requests).collect()))
    assert sorted(map(tuple, search.search_texts(frame(spark, docs), requests).collect())) == want
    monkeypatch.setattr(search, "FEW_WORDS", 1)
    assert sorted(map(tuple, search.search(postings(spark, docs), requests).collect())) == want


def test_refresh_equals_rebuild_and_tombstones(spark):
    old = spark.createDataFrame([("a", 1, 10, 0, False), ("b", 1, 10, 1, False), ("c", 1, 10, 2, False), ("d", 1, 10, 3, True), ("e", 1, 10, 4, False)], "path string, mtime long, size long, file_id long, removed boolean")
    new = spark.createDataFrame([("a", 1, 10), ("b", 2, 10), ("c", 1, 11), ("d", 1, 10), ("f", 1, 1)], "path string, mtime long, size long")
    diff = index.snapshot_diff(old, new)
    assert {(r["path"], r["file_id"], r["change"]) for r in diff.collect()} == {("a", 0, "same"), ("b", 1, "updated"), ("c", 2, "updated"), ("d", 5, "added"), ("e", 4, "removed"), ("f", 6, "added")}
    before = spark.createDataFrame([(0, "x y"), (1, "old"), (2, "z"), (4, "gone")], "file_id long, text string")
    now = spark.createDataFrame([(0, "x y"), (1, "new text"), (2, "z z"), (5, "back"), (6, "f")], "file_id long, text string")
    got = index.apply_refresh(index.build_postings(before), diff, now)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, index.build_postings(now).collect()))


def test_compaction_threshold(spark):
    words = spark.createDataFrame([(i, f"w{i}") for i in range(100)], "word_id long, word string")
    few = spark.createDataFrame([(f"w{i}", 1, 1) for i in range(100) if i != 50], "word string, file_id long, cnt long")
    same = index.compact(words, few, percent=5.0).collect()
    assert len(same) == 100 and all(r["old_id"] == r["new_id"] for r in same)
    dense = {r["old_id"]: r["new_id"] for r in index.compact(words, few, percent=1.0).collect()}
    assert len(dense) == 99 and dense[49] == 49 and dense[51] == 50


def test_stats_and_save(spark, tmp_path):
    post = postings(spark, ["a b a", "b"])
    row = index.stats(post, spark.createDataFrame([("A",), ("B",), ("OLD",)], "word string")).first()
    assert (row["unique_words"], row["total_postings"], row["empty_postings"], row["memory_bytes"], row["total_files"]) == (3, 3, 1, 66, 2)
    files = spark.createDataFrame([("p", 0)], "path string, file_id long")
    at = index.save(post, files, str(tmp_path), 3)
    assert sorted(map(tuple, index.load(spark, at)[0].collect())) == sorted(map(tuple, post.collect()))
    assert index.stats(postings(spark, [])).first()["total_postings"] == 0
    post.write.parquet(f"{tmp_path}/v00000004/postings")  # a version that never got ready
    assert index.current_version(spark, str(tmp_path)) == 3 and index.load_current(spark, f"{tmp_path}/none") is None
    index.save(post, files, str(tmp_path), 5), index.save(post, files, str(tmp_path), 6)
    index.drop_versions(spark, str(tmp_path), 1)
    assert index.current_version(spark, str(tmp_path)) == 6 and not (tmp_path / "v00000005").exists() and (tmp_path / "v00000004").exists()


def test_number_rows(spark):
    got = index.number_rows(spark.range(1000).withColumn("k", 5000 - F.col("id")), ["k"]).collect()
    assert all(r["n"] == 1000 - r["id"] for r in got) and len(got) == 1000
    assert index.number_rows(spark.range(0), ["id"]).count() == 0


def test_refresh_in_one_call(spark, tmp_path):
    from tessera import engine
    from tessera.functions.text import file_name

    docs, folder = tmp_path / "docs", str(tmp_path / "index")
    (docs / "skip").mkdir(parents=True)
    config = EngineConfig(dirs=[str(docs)], extensions=["txt"], exclude=["skip"])
    write = lambda name, text: (docs / name).write_bytes(text.encode("cp866"))
    write("a.txt", "маяк стоит у моря"), write("b.txt", "a boat at the pier"), write("skip/c.txt", "never seen by anyone"), write("d.log", "another kind of file")
    assert engine.refresh(spark, folder, config) == {"added": 2, "updated": 0, "removed": 0, "same": 0}
    requests = spark.createDataFrame([(1, "Маяк"), (2, "boat")], "request_id int, request string")
    names = lambda: {(r["request_id"], r["name"]) for r in engine.answer(spark, folder, requests).withColumn("name", file_name(F.col("path"))).collect()}
    assert names() == {(1, "a.txt"), (2, "b.txt")}
    assert engine.refresh(spark, folder, config) == {"added": 0, "updated": 0, "removed": 0, "same": 2}
    assert index.current_version(spark, folder) == 1
    (docs / "a.txt").unlink()
    write("b.txt", "a ship at the far pier"), write("e.txt", "boat and маяк")
    assert engine.refresh(spark, folder, config) == {"added": 1, "updated": 1, "removed": 1, "same": 0}
    assert names() == {(1, "e.txt"), (2, "e.txt")}
    files = {r["path"].rsplit("/", 1)[-1]: (r["file_id"], r["removed"]) for r in index.load_current(spark, folder)[1].collect()}
    assert files["a.txt"][1] and not files["b.txt"][1] and files["e.txt"] == (2, False)
    write("a.txt", "маяк снова горит")
    assert engine.keep_fresh(spark, folder, config, 0, rounds=2) == [{"added": 1, "updated": 0, "removed": 0, "same": 2}, {"added": 0, "updated": 0, "removed": 0, "same": 3}]
    ids = [r["file_id"] for r in index.load_current(spark, folder)[1].collect()]
    assert sorted(ids) == [0, 1, 2, 3]  # an id is never given twice
    archive = spark.createDataFrame([("7", "x", 0)], "num string, name string, shard_prio int")
    assert engine.answer_journal(spark, folder, "boat", archive, "num", ["name"]).count() == 0


def test_tables_go(spark, tmp_path):
    import os

    from tessera import tables

    one, two = tables.materialise(spark.range(3), "x"), tables.materialise(spark.range(4), "y")
    tables.discard(one)
    assert two.count() == 4 and not os.path.exists(one._tessera_path)
    written = set(tables._WRITTEN[spark.sparkContext.applicationId])
    assert two._tessera_path in written and one._tessera_path not in written
    before = {k: spark.conf.get(k, None) for k in tables.SETTINGS}
    with pytest.raises(ZeroDivisionError), tables.cleaning(spark):
        raise ZeroDivisionError
    assert before == {k: spark.conf.get(k, None) for k in tables.SETTINGS}
    tables.mark(spark, f"{tmp_path}/a/m")
    assert tables.children(spark, str(tmp_path)) == ["a"] and tables.exists(spark, f"{tmp_path}/a/m") and tables.files_under(spark, str(tmp_path))[0][:2] == ("a/m", 0)
