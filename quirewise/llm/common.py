"""Shared pieces: table access, shared scratch space and numpy word kernels."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word bytes after ASCII lower-casing: 0-9, a-z and every non-ASCII byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

_P = np.uint64(0x9E3779B97F4A7C15 | 1)
#: Bytes of words hashed at a time; the tables of powers, which every worker holds, are of 8 bytes each.
_BLOCK = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession, tag: str) -> str:
    """A new folder below the session's spark.checkpoint.dir, which all executors share.

    Only where the session has none and runs on one machine (tests) a local folder serves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/quirewise-{tag}-{uuid.uuid4().hex}"


#: Spark removes a query's shuffle files at its end: nothing reads them again once the table is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Cut lineage: write to shared scratch space as Parquet and read back. The write's shuffle files go."""
    spark = df.sparkSession
    path = scratch_dir(spark, tag)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(*tables: DataFrame) -> None:
    """Remove materialized tables that no later plan reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._scratch)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores in front until it clashes with none of ``columns`` (case aside)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = 1000, size: int = 8 << 20) -> None:
    """Rows that carry whole texts or vectors go to Python at most so many and so many bytes at a time (Spark's
    own defaults are 10,000 and 64 MB), so that a worker and the JVM's buffers beside its heap hold a few MB of
    them. Holds for the session from here on, as plans run later than this."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) <= size:
        spark.conf.set(key, str(size))


_CACHES: list[dict] = []


def worker_cache() -> dict:
    """A dict that tasks of one operator share in a worker process, until another operator's tasks come."""
    _CACHES.append({})
    return _CACHES[-1]


_trimmed = [0.0]


def drop_caches(trim: bool = False) -> None:
    """Called by tasks that need their memory themselves: workers outlive the stages that filled the caches.

    What is free goes back to the system, once a second at most unless ``trim``: an idle worker's share counts
    against its executor."""
    full = any(_CACHES)
    for cache in _CACHES:
        cache.clear()
    if trim or full or time.monotonic() - _trimmed[0] > 1:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError, TypeError):  # not glibc
            pass
        _trimmed[0] = time.monotonic()


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finalizer."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(p: int) -> int:
    return pow(p, -1, 1 << 64)


def _powers(p: int, n: int) -> np.ndarray:
    out = np.full(n, p, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(int(_P), _BLOCK)
_INV = _powers(_inverse(int(_P)), _BLOCK)


def text_slices(column: pa.Array, limit: int = 4 << 20, rows: int | None = None):
    """Yield (first row, last row, bytes, row offsets) over pieces of about ``limit`` bytes and at most ``rows``
    rows; null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, len(column), at + rows if rows else len(column))
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Words of concatenated texts: (starts, ends, doc index, 64-bit hashes of the lower-cased bytes).

    Works in blocks that end between words, so one very long text costs little more than its words.
    """
    low = LOWER[data]
    is_word = IS_WORD[low]
    n = len(low)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, np.uint64)
    first = is_word.copy()
    first[1:] &= ~is_word[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = is_word[cut]
    last = is_word.copy()
    last[:-1] &= ~is_word[1:]
    last[cut - 1] = is_word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + _BLOCK, "right")))
        piece = low[base : ends[to - 1]].astype(np.uint64) + np.uint64(1)
        if len(piece) > len(_POW):  # one giant word
            hashes[at] = np.uint64(int.from_bytes(__import__("hashlib").blake2b(low[base : ends[to - 1]].tobytes(), digest_size=8).digest(), "little"))
            at = to
            continue
        run = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * _POW[: len(piece)], out=run[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        hashes[at:to] = (run[e] - run[s]) * _INV[s] + (e - s).astype(np.uint64)
        at = to
    doc = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, doc, mix64(hashes)


_Q = [np.uint64(pow(0xD1342543DE82EF95, k, 1 << 64)) for k in range(64)]


def windows_of(hashes: np.ndarray, doc: np.ndarray, size: int):
    """Hash of each run of ``size`` consecutive words of one text: (position of its first word, hash)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out += hashes[k : k + n] * _Q[k]
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return at, mix64(out[at])
