"""Shared by the operators: table access, Arrow text buffers, word hashes, blobs.

Texts are handled as the UTF-8 buffers Arrow hands over: words, hashes and
windows are numpy arrays over a whole batch, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlight.plans.session import scratch_path, tune

BATCH_BYTES = 8 << 20  # most bytes in an Arrow batch handed to a task
BLOCK = 1 << 20  # bytes hashed at a time
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)
# fixed values: the five primes of xxHash64
_XX = (
    0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5,
)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_VALUE = np.random.default_rng(20240607).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prepared(spark: SparkSession) -> SparkSession:
    """Session settings of the operators: small Arrow batches, so that a batch of
    very long texts stays within a Python worker's memory."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: one run of its lineage, columns
    pruned when read again, safe when an executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release() -> None:
    """Give freed memory back to the system. A Python worker lives on from stage to stage, and
    would hold the most that any of them took."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)):
        trim(0)


def texts_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty), whatever else the table holds."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )


def total_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


def parts_for(amount: int, each: int, least: int = 1) -> int:
    return int(max(least, -(-amount // each)))


def part_of(column: str, parts: int):
    """Part of a row by the hash of a column; null goes to a part as well."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(parts)).cast("int")


def part_of_row(parts: int):
    """Part of a row by its id and text, for operators that treat rows separately:
    neither rows without an id nor rows of one id meet in a part."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int")


def parts_of_ids(ids: np.ndarray, parts: int) -> np.ndarray:
    """``part_of`` of long values, for rows that are dealt out inside a task: the
    public 64-bit xxHash of eight bytes, with Spark's seed 42."""
    p1, p2, p3, p4, p5 = (np.uint64(p) for p in _XX)
    turn = lambda v, n: (v << np.uint64(n)) | (v >> np.uint64(64 - n))
    h = np.full(len(ids), 42 + 8, np.uint64) + p5
    h ^= turn(ids.astype(np.int64).view(np.uint64) * p2, 31) * p1
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    return (h.view(np.int64) % parts).astype(np.int32)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64 bits."""
    h = h ^ (h >> _S)
    h *= _M1
    h ^= h >> _S
    h *= _M2
    h ^= h >> _S
    return h


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the n + 1 offsets of its texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    off = off.astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``most`` bytes; a longer text is a run of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, j
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without white space) and, for each
    text, the number of words before it (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    inside = ~WHITE[data]
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    cuts = off[:-1][off[:-1] < len(data)]
    before[cuts] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[cuts[cuts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, BLOCK + 4096)
        _powers["up"] = np.cumprod(np.full(size, _BASE, np.uint64))
        _powers["down"] = np.cumprod(np.full(size, _BASE_INVERSE, np.uint64))
    return _powers["up"], _powers["down"]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each span (in rising order), equal for equal bytes; with
    ``lower``, A-Z count as a-z."""
    out = np.empty(len(starts), np.uint64)
    value = _VALUE[LOWER] if lower else _VALUE
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        up, down = _power_table(b - a + 1)
        sums = np.empty(b - a + 1, np.uint64)
        sums[0] = 0
        np.cumsum(value[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[i:j] - a, ends[i:j] - a
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive word hashes, regardless of texts."""
    m = max(0, len(words) - n + 1)
    g = np.zeros(m, np.uint64)
    for k in range(n):
        g *= _BASE
        g += words[k : k + m]
    return mix(g)


def runs_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of each run of equal neighbours."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return first, np.diff(np.append(first, len(values)))


def ranges(first: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Concatenated ``arange(first, first + length)``."""
    total = int(length.sum())
    if not total:
        return np.zeros(0, np.int64)
    start = np.repeat(first - np.concatenate(([0], np.cumsum(length)[:-1])), length)
    return start + np.arange(total)


def blob(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def joined(column, kind) -> np.ndarray:
    """All blobs of a binary column as one array."""
    parts = [v for v in column.to_pylist() if v]
    return np.frombuffer(b"".join(parts), kind) if parts else np.zeros(0, kind)
