"""Shared pieces: fixed text rules, Arrow batches and hashes."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.tables import BATCH_BYTES, cleaning, discard, materialise, shared_folder  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but these (bytes.split() splits at the same six).
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def spaced(text: Column) -> Column:
    """The text with every separator run as one space, without ends; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def word_array(text: Column) -> Column:
    """Words of a text; an empty array where there is none."""
    one = spaced(text)
    return F.when(one == "", F.array().cast("array<string>")).otherwise(F.split(one, " "))


def free_name(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores in front while a column (in any case) has that name."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def roughly_in(df: DataFrame, column: str, ids: DataFrame, bits: int = 22) -> DataFrame:
    """Rows of ``df`` whose ``column`` falls into a hash bucket of some value in ``ids`` (one
    column): all that match and few others, before a join that shuffles wide rows.

    What is broadcast is one row with a bit for each of 2**bits buckets (512 kB), whatever the
    data's size.  Once most buckets are taken it spares nothing and costs a bit test a row; the
    join behind it is the one that counts.
    """
    bucket = lambda c: F.xxhash64(c).bitwiseAND(F.lit((1 << bits) - 1))
    bit = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))
    taken = ids.select(bucket(F.col(ids.columns[0])).alias("b")).groupBy(F.shiftright("b", 6).alias("w")).agg(F.bit_or(bit(F.col("b"))).alias("m"))
    every = df.sparkSession.range(0, 1 << (bits - 6), 1, 1).join(taken, F.col("id") == F.col("w"), "left").select("id", F.coalesce("m", F.lit(0).cast("long")).alias("m"))
    row = every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "m"))), lambda s: s["m"]).alias("taken_"))
    mine = bucket(df[column])
    found = F.get(row["taken_"], F.shiftright(mine, 6).cast("int")).bitwiseAND(bit(mine)) != 0
    return df.join(F.broadcast(row), found, "left_semi")


# ---------------------------------------------------------------- Arrow batches

#: Text bytes that a Python worker handles at once.
CHUNK_BYTES = 2 << 20


def chunks(batches: Iterator[pa.RecordBatch], text: str, most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with their texts as UTF-8 bytes (null: empty), each of about
    ``most`` bytes, or one row where that alone is longer.  No row is cut."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            part = batch.slice(at, to - at)
            yield part, [x or b"" for x in col.slice(at, to - at).cast(pa.binary()).to_pylist()]
            at = to


def give_back() -> None:
    """Free memory that Arrow and the C library keep in this process goes back to the system.  Python
    workers stay for later tasks and share an executor's memory with its JVM."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` (for mapInArrow), which gives free memory back when its partition is done."""

    def then(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return then


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on Python workers of this session get batches of at most ``most`` bytes (or one row),
    unless less is set: results that a caller writes later keep to it, too."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"([0-9]+)b?", spark.conf.get(key, None) or "")
    if now is None or int(now[1]) > most:
        spark.conf.set(key, str(most))


def per_text(docs: DataFrame, text: str, fields: str, make: Callable[[], Callable[[list[bytes]], list]], keep: list[str] | None = None) -> DataFrame:
    """``docs`` (its ``keep`` columns) with further columns ``fields`` (DDL) computed from whole texts.

    ``make()`` runs once in each Python worker task and returns a function from the UTF-8
    texts of a chunk to a list of Arrow arrays or plain lists, one for each field.
    """
    kept = docs.columns if keep is None else keep
    bound_batches(docs.sparkSession)
    source = docs.select(*dict.fromkeys([*(f"`{c}`" for c in kept), f"`{text}`"]))
    extra = docs.sparkSession.createDataFrame([], fields).schema
    from pyspark.sql.types import StructType

    schema = StructType([source.schema[c] for c in kept] + list(extra))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for part, texts in chunks(batches, text):
            own = [part.column(part.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, *(x if isinstance(x, pa.Array) else pa.array(x) for x in work(texts))], names=schema.names)

    return source.mapInArrow(lean(run), schema)


# ---------------------------------------------------------------- 64-bit mixing

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that scatters its input (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a stream of word hashes, one for each start."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = words[:m].copy()
    for k in range(1, n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        h += words[k : k + m]
    return mix(h)


#: Bytes that part words, and a random number for every byte at every place of a word (mod 64).
_PARTS = np.zeros(256, bool)
_PARTS[[32, *range(9, 14)]] = True
_BYTES = mix(np.arange(64 * 256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of UTF-8 bytes: places of all bytes of words, and each word's start and length among the bytes."""
    parts = _PARTS[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], parts, [True])).astype(np.int8)))
    return np.flatnonzero(~parts), edge[::2], edge[1::2] - edge[::2]


def byte_hashes(data: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """64-bit hashes of words: the bytes at ``at``, cut into words of ``lens`` (none is 0) bytes."""
    if not len(lens):
        return np.zeros(0, np.uint64)
    heads = np.cumsum(lens) - lens
    place = np.arange(len(at)) - np.repeat(heads, lens)
    value = _BYTES[((place & 63) << 8) | data[at]]
    if lens.max() > 64:  # further blocks of 64 bytes weigh differently
        value *= (2 * (place >> 6) + 1).astype(np.uint64)
    return mix(np.add.reduceat(value, heads) + lens.astype(np.uint64))


def word_stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (ASCII lower case) of the texts, one text after the other, and how many words each has."""
    data = np.frombuffer(b" ".join(texts).lower(), np.uint8)
    at, starts, lens = word_bounds(data)
    upto = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return byte_hashes(data, at, lens), np.diff(np.searchsorted(starts, upto), prepend=0)
