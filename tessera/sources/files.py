"""Files as tables: directory scans, decoding, attachments and settings."""

from __future__ import annotations

import json
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import text as T
from tessera.tables import exists, files_under


def scan_files(spark: SparkSession, dirs: list[str], extensions: list[str] = (), exclude: list[str] = (), min_size: int = 10, content: bool = True) -> DataFrame:
    """(path, name, mtime, size[, content]) of all files under ``dirs`` that pass the rules.

    Without ``content`` only names and sizes are read.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(dirs))
    kept = found.where(file_rules(F.col("path"), F.col("length"), list(extensions), list(exclude), min_size))
    return kept.select("path", T.file_name(F.col("path")).alias("name"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), *(["content"] if content else []))


def file_rules(path: Column, size: Column, extensions: list[str], exclude: list[str], min_size: int) -> Column:
    """Size, excluded directories (any part of the directory's path) and extension."""
    ok = (size >= min_size) & T.has_extension_scan(T.file_name(path), extensions)
    folder = F.regexp_replace(path, r"[^/\\]*$", "")
    for x in exclude:
        ok = ok & ~F.contains(folder, F.lit(x))
    return ok


def decoder(encoding: str, most: int = 10 << 20):
    """A decoder of file contents in a one-byte encoding, as built-in expressions: bytes are read as the
    first 256 letters and the upper half is translated.  Null, contents with a byte that the
    encoding lacks, and texts longer than ``most`` letters are empty."""
    upper = [bytes([b]).decode(encoding, "replace") for b in range(128, 256)]
    missing = "".join(chr(128 + i) for i, c in enumerate(upper) if c == "\ufffd")

    def decode(content: Column | str) -> Column:
        raw = F.decode(F.col(content) if isinstance(content, str) else content, "ISO-8859-1")
        text = F.translate(raw, "".join(map(chr, range(128, 256))), "".join(upper))
        bad = F.length(raw) > most
        if missing:
            bad |= F.length(F.translate(raw, missing, "")) < F.length(raw)
        return F.when(raw.isNull() | bad, "").otherwise(text)

    return decode


decode_oem = decoder("cp866")
decode_windows = decoder("cp1251")


def casefolded():
    """NFKC case folding (vectorised)."""
    import unicodedata

    @F.pandas_udf(StringType())
    def fold(text: pd.Series) -> pd.Series:
        return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())

    return fold


def file_md5(content: Column) -> Column:
    return F.upper(F.md5(content))


def attachments_in(spark: SparkSession, folder: str) -> DataFrame:
    """(name, content): all files of a folder by relative path."""
    base = folder.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.substring_index("path", base, -1).alias("name"), "content")
    empty = [(name, b"") for name, size, _ in files_under(spark, folder) if not size]
    return found.unionByName(spark.createDataFrame(empty, "name string, content binary")) if empty else found


def text_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, line_no, line) of small header files, read whole."""
    whole = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("file"), "value")
    return whole.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line"))


def shards(spark: SparkSession, paths: list[str]) -> list[DataFrame]:
    """Journal shards in order of priority."""
    return [spark.read.parquet(p) for p in paths]


def shard_order(names: list[str], current: bool) -> list[str]:
    """Existing shards in reading order: the current one first if the year is running, then months
    from the last to the first; the current one alone if there is no month."""
    months = sorted((n for n in names if n[:2].isdigit() and n[2:3] == "-"), reverse=True)
    now = [n for n in names if n.upper().startswith("ARCHIVE")]
    return (now if current or not months else []) + months


#: Where a journal keeps its shards.
CURRENT_SHARD, MONTH_FOLDER, MONTHS = "ARCHIVE.db3", "METH_BASES", 13


def shard_paths(spark: SparkSession, base: str, year: str, now: str) -> list[str]:
    """Paths of a year's shards in order of priority: the current one (whether or not it is there yet)
    if the year is running, months from the last that exist; the current one if there is none."""
    months = [f"{base}/{MONTH_FOLDER}/{m:02d}-{year}.db3" for m in range(MONTHS, 0, -1)]
    found = ([f"{base}/{CURRENT_SHARD}"] if year == now else []) + [m for m in months if exists(spark, m)]
    return found or [f"{base}/{CURRENT_SHARD}"]


def all_shards(spark: SparkSession, base: str) -> list[str]:
    """All shards under a folder: month files (two letters, a hyphen) and current ones."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).select("path", T.file_name(F.col("path")).alias("name"))
    month = (F.instr("name", "-") == 3) & F.endswith("name", F.lit(".db3"))
    return [r["path"] for r in found.where(month | (F.col("name") == CURRENT_SHARD)).orderBy("path").collect()]  # a few a year


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """One file's content; empty where there is none."""
    if not exists(spark, path):
        return b""
    row = spark.read.format("binaryFile").load(path).select("content").first()
    return bytes(row["content"]) if row else b""


def sqlite_table(spark: SparkSession, path: str | list[str], table: str, columns: str) -> DataFrame:
    """A table of SQLite shards as strings with their ``shard_prio``, a task a shard.  Shards come to
    the task as bytes, so any store that Spark reads will do."""
    names = [c.strip() for c in columns.split(",")]
    paths = [path] if isinstance(path, str) else list(path)

    def read(batches):
        import os
        import sqlite3
        import tempfile

        for batch in batches:
            for prio, raw in zip(batch["shard_prio"], batch["content"], strict=True):
                with tempfile.TemporaryDirectory() as folder:  # SQLite opens files only; the copy ends with the task
                    with open(os.path.join(folder, "shard.db3"), "wb") as out:
                        out.write(raw)
                    with sqlite3.connect(f"file:{folder}/shard.db3?mode=ro", uri=True) as db:
                        cursor = db.execute(f"select {', '.join(_quoted(n) for n in names)} from {_quoted(table)}")
                        while rows := cursor.fetchmany(10_000):
                            part = pd.DataFrame([["" if x is None else str(x) for x in r] for r in rows], columns=names)
                            yield part.assign(shard_prio=prio)

    out = None
    for prio, p in enumerate(paths):
        one = spark.read.format("binaryFile").load(p).select(F.lit(prio).alias("shard_prio"), "content")
        out = one if out is None else out.unionByName(one)
    return out.mapInPandas(read, ", ".join(f"{_quoted(n, '`')} string" for n in names) + ", shard_prio int")


def cursor(df: DataFrame):
    """Rows one after the other, a partition at a time on the driver."""
    return df.toLocalIterator(prefetchPartitions=True)


def _quoted(name: str, mark: str = '"') -> str:
    return mark + name.replace(mark, mark * 2) + mark


def read_settings(path: str) -> dict:
    """A settings file; broken or missing files are empty."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}


def prefix_map(path: str) -> tuple[str, dict[str, str]]:
    """Prefix and user suffixes of a prefix-map file."""
    raw = read_settings(path)
    return raw.get("prefix", ""), dict(raw.get("users", {}))


def write_prefix_map(path: str, prefix: str, users: dict[str, str]) -> None:
    Path(path).write_text(json.dumps({"prefix": prefix, "users": users}, ensure_ascii=False, indent=2), encoding="utf-8")


def backup_jobs(path: str) -> list[dict]:
    """Backup groups of a settings file (backup_dir, period_sec, targets of src, max_versions and
    is_directory); groups that lack something or have no target are left out."""
    raw = read_settings(path)
    listed = raw.get("BackupJobs") if isinstance(raw, dict) else None
    out = []
    for group in listed if isinstance(listed, list) else []:
        try:
            targets = [{"src": t["src"], "max_versions": t.get("max_versions", 5), "is_directory": t.get("is_directory", False)} for t in group["targets"]]
            if targets:
                out.append({"backup_dir": group["backup_dir"], "period_sec": group.get("period_sec", 3600), "targets": targets})
        except (KeyError, TypeError, AttributeError):
            continue
    return out


def walk_events(spark: SparkSession, dirs: list[str], extensions: list[str] = ()) -> DataFrame:
    """(path, ts, seq, event): an Added event for every file under ``dirs`` that has any bytes, as when
    watching begins or a folder comes back."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(dirs))
    kept = found.where(T.has_extension_event(T.file_name(F.col("path")), list(extensions)))
    return kept.select("path", F.current_timestamp().alias("ts"), F.monotonically_increasing_id().alias("seq"), F.lit("Added").alias("event"))


def save_attachments(files: DataFrame, folder: str) -> None:
    """Sink: write a message's files (name, content) under ``folder``, with the folders of their names."""
    import os

    for r in files.toLocalIterator():
        path = os.path.join(folder, r["name"])
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as out:
            out.write(r["content"])
