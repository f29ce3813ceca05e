"""Tables in the folder that driver and executors share, between the steps of one computation."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir.  Where it is unset, a local master (tests, one machine)
    gets a folder of its own; a cluster gets an error, as its machines share no local folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named


#: Bytes of a batch that goes to a Python worker; it stands in the JVM and in the worker at once.
BATCH_BYTES = 4 << 20
#: Spark's settings for these writes: a query's shuffle files go when the query has ended, and a Python
#: worker gets batches of a bounded size, however long the texts (a single longer row is a batch).
SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
#: For tables whose rows take some hundred kilobytes each.  Parquet looks at the size of a page and of a row group after 100 rows only,
#: and Spark reads 4096 rows at once: ten megabytes and more in one array of the JVM's heap, and as much outside it to compress a page.
LARGE_WRITE = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "4", "parquet.page.row.count.limit": "4", "parquet.block.row.count.limit": "32", "parquet.enable.dictionary": "false"}
LARGE_SETTINGS = {"spark.sql.parquet.columnarReaderBatchSize": "16", "spark.sql.execution.arrow.maxBytesPerBatch": str(1 << 20)}


@contextmanager
def cleaning(spark: SparkSession, large: bool = False):
    """SETTINGS hold for the queries that run inside, and LARGE_SETTINGS if they read or write large rows."""
    settings = SETTINGS | (LARGE_SETTINGS if large else {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


#: Paths of the tables that stand, by application.
_WRITTEN: dict[str, set[str]] = {}


def materialise(df: DataFrame, tag: str, large: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there,
    so a lost executor costs a re-read and no recomputation.  Shuffle files of the finished
    write are of no more use and are deleted with it.  ``large``: rows read or written take some hundred kilobytes each."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tessera-{tag}-{uuid.uuid4().hex}"
    with cleaning(spark, large):
        df.write.options(**(LARGE_WRITE if large else {})).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tessera_path = path
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``materialise`` that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_tessera_path", None):
            delete(df.sparkSession, path)
            _WRITTEN.get(df.sparkSession.sparkContext.applicationId, set()).discard(path)


def discard_all(spark: SparkSession) -> int:
    """Delete all tables of this application that still stand and return how many.  Results read tables
    until they are written, so this is for the end of a session or after its last result."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, set())
    for path in paths:
        delete(spark, path)
    return len(paths)


# ---------------------------------------------------------------- files of any store that Spark reads


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    at, fs = _at(spark, path)
    fs.delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none where there is no such folder."""
    at, fs = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def mark(spark: SparkSession, path: str) -> None:
    """Create an empty file, in one step that readers see whole or not at all."""
    at, fs = _at(spark, path)
    fs.create(at, True).close()


def copy(spark: SparkSession, source: str, target: str) -> None:
    """Copy one file, with its folders and modification time."""
    (a, fs), (b, to) = _at(spark, source), _at(spark, target)
    to.mkdirs(b.getParent())
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, b, False, True, spark.sparkContext._jsc.hadoopConfiguration())
    to.setTimes(b, fs.getFileStatus(a).getModificationTime(), -1)


def files_under(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """Relative path, size and modification time (milliseconds) of all files under a folder, empty ones
    too, which Spark's file sources leave out; for folders that one machine can list."""
    at, fs = _at(spark, folder.rstrip("/"))
    base = fs.makeQualified(at).toString().rstrip("/") + "/"
    found, out = fs.listFiles(at, True), []
    while found.hasNext():
        f = found.next()
        out.append((f.getPath().toString().removeprefix(base), f.getLen(), f.getModificationTime()))
    return sorted(out)
