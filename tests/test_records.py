import itertools
import time

import pytest
from pyspark.sql import functions as F

from tessera.config import EngineConfig
from tessera.functions import text as T
from tessera.operators import events, journal, registry, upkeep
from tessera.sources import files
from tessera.streaming import file_events


def column(spark, values, make):
    rows = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r["x"] for r in rows.select("i", make(F.col("t")).alias("x")).orderBy("i").collect()]


def test_merge_pairs(spark):
    pairs = list(itertools.product(events.KINDS, events.KINDS))
    rows = spark.createDataFrame(pairs, "a string, b string")
    got = [r["m"] for r in rows.select(events.merge(F.col("a"), F.col("b")).alias("m")).collect()]
    assert got == [events.merge_python(a, b) for a, b in pairs]
    table = dict(zip(pairs, got))
    assert table["Removed", "Added"] == "Removed" and table["RenamedOld", "RenamedNew"] == "Added" and table["Added", "Modified"] == "Added" and table["Removed", "RenamedOld"] == "RenamedOld"


def test_first_event_stays_as_it_is(spark):
    rows = spark.createDataFrame([("p", "2024-01-01 00:00:01", 1, "RenamedNew"), ("q", "2024-01-01 00:00:01", 2, "Added"), ("q", "2024-01-01 00:00:02", 3, "Modified"), ("q", "2024-01-01 00:00:09", 4, "Removed")], "path string, ts string, seq long, event string")
    got = events.merge_events(rows.withColumn("ts", F.to_timestamp("ts"))).orderBy("path", "start").collect()
    assert [(r["path"], r["event"], r["n"]) for r in got] == [("p", "RenamedNew", 1), ("q", "Added", 2), ("q", "Removed", 1)]


def test_routes(spark):
    assert column(spark, ["in7/x.zag", "in7/x.txt", "inx/x", "a/OUT/b", "x/in12/y"], T.routed) == ["rewrite", "drop", "index", "index", "drop"]
    assert column(spark, ["a/OUT/b", "a/b"], T.is_outgoing) == [True, False]


def test_names(spark):
    assert column(spark, ["123", "123.txt", "12a.txt", "123.4.txt", "123."], T.numeric_name) == ["123", "123", "", "", "123"]
    assert column(spark, ["123", "a.b", ".hidden"], T.record_type) == [0, 1, 0]
    assert column(spark, ["a.txt", "atxt", "a", "a.", "b.TXT"], lambda c: T.has_extension_scan(c, ["txt"])) == [True, True, False, False, True]
    assert column(spark, ["a.txt", "atxt", "a", "a.", "b.atxt"], lambda c: T.has_extension_event(c, ["txt", ""])) == [True, True, True, True, True]
    assert column(spark, ["a.txt", "b.atxt", "a"], lambda c: T.has_extension_registry(c, [".TXT"])) == [True, False, False]


def block(text):
    """The marked block of a text, by plain loops over bytes."""
    import re

    lines = [re.sub(" +", " ", x.strip()) for x in text.split("\n")[3:]]
    lines = [x for x in lines if "ЛИЧНО" not in x]
    start = next((i for i, x in enumerate(lines) if re.match(rb"^\s{0,3}=.{4,90}", x.encode())), None)
    if start is None:
        return ""
    end = next((i for i in range(start, len(lines)) if re.match(rb"^.{4,90}=\s*", lines[i].encode())), None)
    if end is None:
        return ""
    whole = " ".join(lines[start : end + 1])
    return whole[: whole.rindex("=") + 1]


def test_marked_block(spark):
    cases = ["1\n2\n3\n=short text here=", "1\n2\n3\nx\n= opens here\nmiddle\nends here = tail\nmore", "1\n2\n3\n=ab=", "=no\nskip\nlines\nx", "1\n2\n3\n=ЛИЧНО secret=\n=after it all=", "1\n2\n3\n= " + "ж" * 60 + "=", "1\n2\n3\n= never closed", "1\n2\n3\n=" + "ж" * 20 + "= tail", "", "1\n2\n3\n= a = b ="]
    assert column(spark, cases, T.marked_block) == [block(c) for c in cases]
    assert column(spark, ["1\n2\n3\n= some text, here ="], lambda c: T.summary(c, F.length(c))) == ["Some text,  here"]
    began = time.time()
    assert column(spark, ["1\n2\n3\n= " + "x" * 2_000_000 + " = "], lambda c: F.length(T.marked_block(c))) == [0]
    assert time.time() - began < 60


def test_marked_block_keeps_odd_separators(spark):
    lines = ["= one\x0b", "\x0b two \u2028", " \t= three\u2028", " more = "]
    assert column(spark, ["1\n2\n3\n" + "\n".join(lines), None], T.marked_block) == ["= one\x0b \x0b two \u2028 = three\u2028 more =", ""]
    assert column(spark, ["1\n2\n3\n=\x0b\xdfABC\u03a3 \u2028=\n", "1\n2\n3\n= \xdfABC\u03a3 ="], lambda c: T.summary(c, F.length(c))) == ["\x0b\xdfabc\u03c3 \u2028", "\u1e9eabc\u03c3"]


def test_capitals_letter_by_letter(spark):
    """One letter stays one letter, as in SQL, and a letter's neighbours do not change it."""
    cases = ["\xdfACH", "\ufb01N", "\u1f80B", "\u1f88B", "\u0149A", "x\u0130Y", "A\u039f\u03a3 \u03a3", "\U00010d70A", "a\U00010d50B\u1c89", "\u01c6A", "\u03a3", "x"]
    assert column(spark, cases, T.capitalise) == ["\u1e9each", "\ufb01n", "\u1f88b", "\u1f88b", "\u0149a", "Xiy", "A\u03bf\u03c3 \u03c3", "\U00010d70a", "A\U00010d50b\u1c89", "\u01c4a", "\u03a3", "X"]
    import duckdb

    sql = "SELECT list_transform(?, lambda t: upper(t[1:1]) || lower(t[2:]))"
    assert column(spark, cases, T.capitalise) == duckdb.execute(sql, [cases]).fetchone()[0]


def test_scalars(spark):
    assert column(spark, ["ЖУК ест", "straße", "", None], T.capitalise) == ["Жук ест", "Straße", "", None]
    assert column(spark, ["12x", "-4", "x", "99999999999"], T.leading_int) == [12, -4, None, None]
    assert column(spark, ["where upper(a) like ('%b%')", "get upper(ffrom) like ('%ab%') limit 5", "other"], T.summarize_sql) == ["where upper(a) like ('%b%')", "ffrom ab limit 5 ", "other"]
    assert column(spark, ["1", "1000"], lambda c: T.request_label(c.cast("int"))) == ["request001", "request1000"]
    assert column(spark, ["Исх. № 17; b", "17", None], T.outgoing_number) == [17, 0, 0]
    assert column(spark, ["it''s a 'q' \"\"x", "a" * 120], T.shorten) == ['it"s a "q" "x', "a" * 100]
    pairs = F.create_map(F.lit("old"), F.lit("new"))
    headers = ["From=old", "a\nFrom= old \nFrom=old\n", "xFrom=old", "a\nFrom=other\nFrom=old", "To=x", "From=old\nb\n"]
    want = ["From=new", "a\nFrom=new\nFrom=old\n", "xFrom=old", "a\nFrom=other\nFrom=old", "To=x", "From=new\nb\n"]
    assert column(spark, headers, lambda c: T.rewritten_header(c, pairs)) == want
    rows = spark.createDataFrame(list(enumerate(headers)), "id int, text string")
    table = spark.createDataFrame([("old", "new")], "key string, value string")
    assert [r["text"] for r in upkeep.rewrite_headers(rows, table).orderBy("id").collect()] == want


def test_journal(spark):
    shards = [spark.createDataFrame(rows, "num string, name string") for rows in ([("2", "new"), ("3", None)], [("1", "old"), ("2", "older")])]
    archive = journal.union_shards(shards)
    assert [tuple(r) for r in journal.as_texts(journal.journal_query(archive, F.col("num") >= "2", ["num"], 2)).select("num", "name").collect()] == [("2", "new"), ("3", "")]
    archive = journal.as_texts(archive)
    assert {r["num"]: r["name"] for r in journal.first_shard_lookup(archive, "num", ["name"]).collect()} == {"1": "old", "2": "new", "3": ""}
    hits = spark.createDataFrame([(1, "d/2", 1.0), (2, "d/2", 0.9), (3, "d/9", 0.5), (4, "d/2.txt", 0.4), (5, "d/abc", 0.1)], "rank int, path string, relevance float")
    got = [(r["rank"], r["type"], r["num"], r["name"]) for r in journal.search_journal(hits, archive, "num", ["name"]).orderBy("rank").collect()]
    assert got == [(1, 0, "2", "new"), (3, 0, "", ""), (4, 1, "2", "new")]


def test_journal_conditions_reach_the_scan(spark, tmp_path):
    for i in range(2):
        spark.createDataFrame([(i, "x" * 50, "y")], "num long, name string, other string").write.parquet(f"{tmp_path}/{i}")
    archive = journal.union_shards([spark.read.parquet(f"{tmp_path}/{i}") for i in range(2)])
    plan = journal.journal_query(archive, "num > 0", ["num"]).select("num", "shard_prio")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(num,0)" in plan and "other" not in plan


def test_journal_json(spark, tmp_path):
    import json

    hits = spark.createDataFrame([(2, 'a "b"', "7", 0.5), (1, "c", None, 1.0)], "rank int, path string, num string, rel double").fillna("")
    journal.write_json(journal.result_json(hits), f"{tmp_path}/j.json")
    assert json.loads((tmp_path / "j.json").read_text()) == [{"path": "c", "num": "", "rel": 1.0}, {"path": 'a "b"', "num": "7", "rel": 0.5}]


def test_journal_by_condition(spark):
    import json

    from pyspark.errors import ParseException

    from tessera import engine

    names = ["index", "ddata", "ffrom", "telno", "podpno", "datapodp", "familia", "prilname1", "kolpril", "copyes2", "gdesht", "podrazd", "directto", "filename"]
    shards = [spark.createDataFrame([(n, *names[1:-1], f"f{n}") for n in ids], ", ".join(f"`{c}` {'long' if c == 'index' else 'string'}" for c in names)) for ids in ([7, 5], [6, 9])]
    rows = engine.journal_json(journal.union_shards(shards), journal.INCOMING, "index > 5 and ffrom like 'ff%'", ["index"], 2).orderBy("rank").collect()
    got = [json.loads(r["json"]) for r in rows]
    assert [r["rank"] for r in rows] == [1, 2] and [g["num"] for g in got] == ["7", "6"] and set(got[0]) == set(journal.RESULT)
    assert (got[0]["isp"], got[0]["tel_num"], got[0]["path"], got[0]["type"], got[0]["rel"]) == ("familia", "telno", "directtof7", 0, 1.0)
    with pytest.raises(ParseException):
        engine.journal_json(journal.union_shards(shards), journal.INCOMING, "index > 5 limit 1", ["index"])


def test_single_attachment(spark):
    record = spark.createDataFrame([("a;b",)], "prilname string")
    listing = spark.createDataFrame([("a", b"xyz")], "name string, content binary")
    get = lambda r, n: bytes(journal.single_attachment(r, listing, n).first()[0])
    assert get(record, "a") == b"xyz" and get(record, "zz") == b"" and get(record.where("false"), "a") == b"[]"


def test_registry_order(spark):
    new = spark.createDataFrame([("1", "ЖЭК", "3", "summary"), ("2", "транзит", "3", "s2"), ("3", "ЖЭК", "none", ""), ("4", None, "0", "s4")], "num string, podrazd string, lists string, kr string")
    archive = spark.createDataFrame([("1", "old", ""), ("2", "old", ""), ("4", "old", "8")], "num string, kr string, lists string")
    base = spark.createDataFrame([("1", "0", "x"), ("9", "1", "y")], "num string, lists string, kr string")
    updated, rows = registry.register_events(new, archive, base)
    assert {r["num"]: r["kr"] for r in updated.collect()} == {"1": "summary", "2": "s2", "4": "s4"}
    assert {r["num"]: (r["lists"], r["kr"]) for r in rows.collect()} == {"1": ("3", "summary"), "4": ("8", "s4"), "9": ("1", "y")}


def test_ini_pairs(spark):
    lines = ["key one ", "s=VALUE/x", "s=NO", "k2", "s=V 2", "k3", "s=/z", "key one", "s=LATER"]
    rows = spark.createDataFrame([("f", i, x) for i, x in enumerate(lines)], "file string, line_no int, line string")
    assert {r["key"]: r["value"] for r in upkeep.ini_pairs(rows).collect()} == {"key one": "VALUE", "k2": "V"}


def test_queue_and_delays(spark):
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00", 0, True), (2, "2024-01-01 00:00:00", 0, False), (3, "2024-01-01 00:00:59", 0, True), (4, "2024-01-01 00:00:00", 20, True)], "seq long, ts string, tries int, ready boolean").withColumn("ts", F.to_timestamp("ts"))
    now = F.expr("timestamp '2024-01-01 00:01:00'")
    assert [r["state"] for r in events.delayed_due(rows, now).orderBy("seq").collect()] == ["run", "later", "wait", "failed"]
    assert [r["state"] for r in events.tick(rows, now).orderBy("seq").collect()] == ["run", "run", "back", "stay"]


def test_files(spark, tmp_path):
    for name, raw in (("a.txt", "Привет, мир!".encode("cp866")), ("skip/b.txt", b"0123456789abc"), ("c.atxt", b"short"), ("d", b"0123456789")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    found = files.scan_files(spark, [str(tmp_path)], ["txt", ""], ["skip"]).select("name", files.decode_oem("content").alias("text"))
    assert {r["name"]: r["text"] for r in found.collect()} == {"a.txt": "Привет, мир!", "d": "0123456789"}
    assert files.shard_order(["ARCHIVE.db3", "02-x.db3", "11-x.db3"], True) == ["ARCHIVE.db3", "11-x.db3", "02-x.db3"]
    assert files.shard_order(["ARCHIVE.db3"], False) == ["ARCHIVE.db3"]
    assert files.read_bytes(spark, f"{tmp_path}/d") == b"0123456789" and files.read_bytes(spark, f"{tmp_path}/none") == b""
    seen = {(r["path"].rsplit("/", 1)[-1], r["event"]) for r in files.walk_events(spark, [str(tmp_path)], ["txt"]).collect()}
    assert seen == {("a.txt", "Added"), ("b.txt", "Added"), ("c.atxt", "Added")}


def test_decoders_byte_by_byte(spark):
    rows = [(i, bytes([i])) for i in range(256)] + [(300, bytes(range(256))), (301, None), (302, b"x" * 20)]
    table = spark.createDataFrame(rows, "i int, content binary")
    short = files.decoder("cp866", most=15)
    got = {r["i"]: r for r in table.select("i", files.decode_oem("content").alias("o"), files.decode_windows("content").alias("w"), short("content").alias("s")).collect()}
    for i, raw in rows:
        assert got[i]["o"] == (raw or b"").decode("cp866")
        assert got[i]["w"] == ("" if b"\x98" in (raw or b"") else (raw or b"").decode("cp1251"))
    assert got[302]["s"] == "" and got[65]["s"] == "A"
    fold = files.casefolded()
    assert [r["x"] for r in spark.createDataFrame([(0, "ＡＢ Straße ﬁ"), (1, None)], "i int, t string").select("i", fold("t").alias("x")).orderBy("i").collect()] == ["ab strasse fi", None]


def test_shards_are_found(spark, tmp_path):
    base = tmp_path / "base"
    (base / "METH_BASES").mkdir(parents=True)
    for name in ("METH_BASES/03-2024.db3", "METH_BASES/11-2024.db3", "METH_BASES/11-2023.db3", "METH_BASES/x.db3", "ARCHIVE.db3"):
        (base / name).write_bytes(b"x")
    tail = lambda paths: [p.rsplit("/", 1)[-1] for p in paths]
    assert tail(files.shard_paths(spark, str(base), "2024", "2024")) == ["ARCHIVE.db3", "11-2024.db3", "03-2024.db3"]
    assert tail(files.shard_paths(spark, str(base), "2024", "2025")) == ["11-2024.db3", "03-2024.db3"] and tail(files.shard_paths(spark, str(base), "2020", "2025")) == ["ARCHIVE.db3"]
    assert sorted(tail(files.all_shards(spark, str(base)))) == ["03-2024.db3", "11-2023.db3", "11-2024.db3", "ARCHIVE.db3"]


def test_uploads_one_after_the_other(spark):
    there = [("old.txt", 3), ("old(1).txt", 3), ("n", 1), (".hidden", 2)]
    new = [(1, "old.txt", 3), (2, "old.txt", 4), (3, "old.txt", 4), (4, "old(1).txt", 9), (5, "n", 2), (6, "n", 5), (7, "n(1)", 2), (8, ".hidden", 1), (9, "fresh.tar.gz", 1), (10, "fresh.tar.gz", 2), (11, "old.txt", 3)]
    got = upkeep.upload_names(spark.createDataFrame(new, "seq long, name string, size long"), spark.createDataFrame(there, "name string, size long"))
    assert [r["saved_as"] for r in got.orderBy("seq").collect()] == ["old.txt", "old(2).txt", "old(3).txt", "old(1)(1).txt", "n(1)", "n(2)", "n(1)", ".hidden(1)", "fresh.tar.gz", "fresh.tar(1).gz", "old.txt"]
    taken = {"a.b": 1, **{f"a({i}).b": 1 for i in range(1, 1001)}, "a(1001a).b": 1}
    assert upkeep.save_as("a.b", 2, taken) == "a(1002b).b"
    names = list(itertools.islice(upkeep.numbered_name("a", ""), 1000, 1029))
    assert names[25:28] == ["a(1026z)", "a(1028a)", "a(1029b)"]


def test_uploads_of_other_kinds(spark, tmp_path):
    from datetime import date, datetime

    moment = datetime(2024, 3, 2, 4, 5)
    assert upkeep.upload_folder("a/b\\c.txt", moment) == ("a/b_04-05", "c.txt") and upkeep.upload_folder("c.txt", moment) == ("", "c.txt")
    assert upkeep.log_path("logs", "scan", date(2024, 3, 2)) == "logs/2024/03/02.03.2024/scan.log" and upkeep.ping("PING") == "PONG" and upkeep.ping("x") is None
    files.save_attachments(spark.createDataFrame([("x/y.bin", b"12"), ("z", b"")], "name string, content binary"), f"{tmp_path}/box/7")
    found = upkeep.attachments_of(spark, "u", f"{tmp_path}/box/", {"u": "7", "v": "8"})
    assert {(r["name"], bytes(r["content"])) for r in found.collect()} == {("x/y.bin", b"12"), ("z", b"")}
    assert upkeep.attachments_of(spark, "v", f"{tmp_path}/box/", {"v": "8"}) == "Net prilojeniy!" and upkeep.attachments_of(spark, "w", "", {}) == "Operator no found!"
    log = spark.createDataFrame([("2024-01-01 02:03:04", "q", "get upper(f) like ('%ab%') limit 5", "u")], "ts string, request_type string, request_text string, user_name string")
    for _ in range(2):
        upkeep.request_log_append(log, f"{tmp_path}/log")
    assert [(str(r["date"]), r["time"], r["request_text"]) for r in spark.read.parquet(f"{tmp_path}/log").collect()] == [("2024-01-01", "02:03:04", "f ab limit 5 ")] * 2


def test_backup_runs(spark, tmp_path):
    import os
    from datetime import datetime

    source, root = tmp_path / "home" / "data", tmp_path / "safe"
    (source / "sub").mkdir(parents=True)
    root.mkdir()
    (source / "a").write_text("one")
    (source / "sub" / "b").write_text("two")
    (source / "none").write_text("")
    run = lambda minute, most=2: upkeep.run_backup(spark, str(source), str(root), datetime(2024, 1, 1, 0, minute), most)
    assert run(0) == ["a", "none", "sub/b"] and (root / "data_backup" / "none").exists() and (root / "data_backup" / "sub" / "b").read_text() == "two" and run(1) == []
    for minute in (2, 3, 4):
        (source / "a").write_text(f"one {minute}")
        os.utime(source / "a", (2_000_000_000 + minute,) * 2)
        assert run(minute) == ["a"]
    assert sorted(p.name for p in root.iterdir()) == ["data_backup", "home_data_20240101_000300", "home_data_20240101_000400"]
    assert (root / "data_backup" / "a").read_text() == "one 4" and (root / "home_data_20240101_000300" / "a").read_text() == "one 3"
    one = tmp_path / "home" / "data" / "a"
    single = lambda minute: upkeep.run_file_backup(spark, str(one), str(root), datetime(2024, 2, 1, 0, minute), 1)
    assert single(0) and not single(1) and (root / "data_a_base" / "a").read_text() == "one 4"
    for minute in (2, 3):
        os.utime(one, (2_100_000_000 + minute,) * 2)
        assert single(minute)
    assert [p.name for p in sorted(root.iterdir()) if p.name.startswith("data_a_2")] == ["data_a_20240201_000300"]
    group = {"backup_dir": str(root), "period_sec": 1, "targets": [{"src": str(source), "max_versions": 2, "is_directory": True}, {"src": str(tmp_path / "gone"), "max_versions": 2, "is_directory": True}, {"src": str(source / "gone"), "max_versions": 2, "is_directory": False}]}
    assert upkeep.run_backup_group(spark, group, datetime(2024, 3, 1)) == {str(source): 1, str(tmp_path / "gone"): 0, str(source / "gone"): 0}
    for text in ("began", "ended"):
        upkeep.write_log(str(tmp_path / "logs"), "backup", text, datetime(2024, 3, 2, 4, 5, 6))
    assert (tmp_path / "logs/2024/03/02.03.2024/backup.log").read_text() == "02.03.2024 04:05:06 began\n02.03.2024 04:05:06 ended\n"
    jobs = tmp_path / "jobs.json"
    jobs.write_text('{"BackupJobs": [{"backup_dir": "d", "targets": [{"src": "s"}, {"src": "t", "max_versions": 2, "is_directory": true}]}, {"targets": [{"src": "x"}]}, {"backup_dir": "e", "targets": []}, 7]}')
    assert files.backup_jobs(str(jobs)) == [{"backup_dir": "d", "period_sec": 3600, "targets": [{"src": "s", "max_versions": 5, "is_directory": False}, {"src": "t", "max_versions": 2, "is_directory": True}]}]
    assert files.backup_jobs(str(tmp_path / "none.json")) == []


def test_sqlite_shard(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "a.db3") as db:
        db.execute('create table ARCHIVE ("Index" integer, kr text)')
        db.execute("insert into ARCHIVE values (1, null), (2, 'b')")
    assert [tuple(r) for r in files.sqlite_table(spark, str(tmp_path / "a.db3"), "ARCHIVE", "Index, kr").orderBy("Index").collect()] == [("1", "", 0), ("2", "b", 0)]
    two = files.sqlite_table(spark, [str(tmp_path / "a.db3")] * 2, "ARCHIVE", "kr")
    assert sorted(map(tuple, files.cursor(two))) == [("", 0), ("", 1), ("b", 0), ("b", 1)]


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    assert EngineConfig.load(path).limit == 30 and EngineConfig.load(path).problems()
    EngineConfig(limit=3, dirs=["d"], extensions=["txt"]).save(path)
    assert EngineConfig.load(path).limit == 3 and not EngineConfig.load(path).problems()


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "1.json").write_text('{"path":"a","ts":"2024-01-01T00:00:00Z","seq":1,"event":"Added"}\n{"path":"a","ts":"2024-01-01T00:00:01Z","seq":2,"event":"Modified"}\n{"path":"b","ts":"2024-01-01T00:00:01Z","seq":3,"event":"Removed"}\n')
    query = file_events.merged_stream(file_events.read_events(spark, str(source)), 1000).writeStream.format("memory").queryName("merged").outputMode("update").option("checkpointLocation", str(tmp_path / "c1")).trigger(processingTime="1 second").start()
    try:
        for _ in range(60):
            if spark.table("merged").count() == 2:
                break
            time.sleep(1)
        assert {(r["path"], r["event"], r["n"]) for r in spark.table("merged").collect()} == {("a", "Added", 2), ("b", "Removed", 1)}
    finally:
        query.stop()


def test_incremental_index_equals_rebuild(spark, tmp_path):
    from tessera.operators.index import build_postings

    texts = spark.createDataFrame([(1, "one two"), (2, "two two"), (3, "three")], "file_id long, text string")
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema("path string, event string, file_id long").option("maxFilesPerTrigger", 1).json(str(source))
    for i, rows in enumerate(['{"path":"1","event":"Added","file_id":1}\n{"path":"2","event":"Added","file_id":2}', '{"path":"1","event":"Removed","file_id":1}\n{"path":"3","event":"Modified","file_id":3}']):
        (source / f"{i}.json").write_text(rows)
        run = file_events.keep_index(stream, lambda ids: texts.join(ids, "file_id"), str(tmp_path / "index"), str(tmp_path / "c2")).trigger(availableNow=True).start()
        run.awaitTermination()
    got = sorted(map(tuple, file_events.postings_of(spark, str(tmp_path / "index")).collect()))
    assert got == sorted(map(tuple, build_postings(texts.where("file_id > 1")).collect()))


def test_stream_gives_ids_and_merges(spark, tmp_path):
    from tessera.operators.index import build_postings

    source, folder = tmp_path / "in", str(tmp_path / "index")
    source.mkdir()
    texts = {"a": "one two", "b": "two two", "c": "three"}
    table = spark.createDataFrame(list(texts.items()), "path string, text string")
    stream = spark.readStream.schema("path string, event string").option("maxFilesPerTrigger", 1).json(str(source))
    batches = [[("a", "Added"), ("b", "Added")], [("a", "Removed"), ("c", "Added")], [("b", "Modified"), ("x", "Removed")], [("a", "Added")], [("c", "RenamedOld")]]
    ids = []
    for i, rows in enumerate(batches):
        (source / f"{i}.json").write_text("\n".join(f'{{"path":"{p}","event":"{e}"}}' for p, e in rows))
        file_events.keep_index(stream, lambda due: table.join(due, "path"), folder, str(tmp_path / "c3"), merge_every=2).trigger(availableNow=True).start().awaitTermination()
        ids.append({r["path"]: r["file_id"] for r in file_events.paths_of(spark, folder).where("path is not null").collect()})
    assert ids[0] == {"a": 0, "b": 1} and ids[1] == {"b": 1, "c": 2} and ids[3] == {"b": 1, "c": 2, "a": 3} and ids[4] == {"b": 1, "a": 3}
    want = build_postings(spark.createDataFrame([(1, texts["b"]), (3, texts["a"])], "file_id long, text string"))
    assert sorted(map(tuple, file_events.postings_of(spark, folder).collect())) == sorted(map(tuple, want.collect()))
    assert {p.name for p in (tmp_path / "index").iterdir()} == {"base-00000003", "delta-00000004"}
    assert file_events.postings_of(spark, f"{folder}-none").count() == 0


def _core():
    from tessera.plans import index_queries, record_queries  # noqa: F401
    from tessera.plans.registry import SQL

    return sorted(SQL)


@pytest.mark.parametrize("name", _core())
def test_registered_queries_match_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "events", "customer", "labels", "orders", "lineitem", "part", "pages", "conversations", "nation", "supplier", "region"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    cursor = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cursor.description]
    got = entry.queries()[name](spark, sf)
    assert sorted(cols) == sorted(got.columns)
    assert sorted(map(repr, cursor.fetchall())) == sorted(repr(tuple(r)) for r in got.select(*cols).collect())


def test_every_query_has_sql():
    from tessera.plans.registry import QUERIES, SQL

    assert set(QUERIES) == set(SQL)
