"""Helpers that the operators of this subpackage share: tables, cut lineage, vectorised word hashes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Hashable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as it needs to be no column of ``df``, whose own columns stay as they are."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder, or in local mode one of our own if unset."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local") or sc.master.startswith("local-cluster") and not folder:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


#: Bytes and rows that pass to or from Python at once at most.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 4000


def small_batches(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of the session, as a task holds one or two with their copies; smaller settings stay."""
    for name, most in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)):
        now = int(re.sub(r"\D", "", spark.conf.get(name)))
        if not 0 < now <= most:
            spark.conf.set(name, str(most))
    return spark


def lean_worker(keep: Hashable = None) -> None:
    """Give memory back that this Python worker holds from the tasks before: kept state other than ``keep``, and free memory."""
    held = sys.modules["_panelspark_worker"].held if "_panelspark_worker" in sys.modules else {}
    for key in [k for k in held if k != keep]:
        del held[key]
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not in every C library
        ctypes.CDLL(None).malloc_trim(0)


def worker_state(key: Hashable, make: Callable):
    """What ``make`` returns, made once in each Python worker and kept for its later tasks; the newest four are kept."""
    held = sys.modules.setdefault("_panelspark_worker", types.ModuleType("_panelspark_worker")).__dict__.setdefault("held", {})
    if key not in held:
        while len(held) >= 4:
            held.pop(next(iter(held)))
        held[key] = make()
    return held[key]


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet into the shared folder and read it again.

    The files survive lost executors, and later reads prune columns. ``release`` deletes them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._table_path = path
    return made


def release(*tables: DataFrame) -> None:
    """Delete materialised tables that no lazy result reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._table_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


# --- vectorised words -------------------------------------------------------------------------

SLICE_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POWERS:
        up, down = np.full(n, _BASE), np.full(n, _INVERSE)
        up[0] = down[0] = 1
        _POWERS.clear()
        _POWERS[n] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[n]


def fold_ascii() -> np.ndarray:
    """Byte table that lower-cases A-Z and keeps every other byte."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def white_space() -> np.ndarray:
    """Separators: space and the bytes 9 to 13."""
    t = np.zeros(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = True
    return t


def non_letters() -> np.ndarray:
    """Separators: every ASCII byte that is no letter; bytes of longer UTF-8 sequences count as letters."""
    t = np.ones(256, bool)
    t[65:91] = t[97:123] = False
    t[128:] = False
    return t


class Words:
    """Words of some texts: ``doc`` (index of the text), ``start`` and ``end`` (bytes in the slice), ``hash``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, separators: np.ndarray, fold: np.ndarray):
        self.n_docs = len(bounds) - 1
        word = ~separators[data]
        first = np.zeros(len(data) + 1, bool)
        first[bounds] = True
        starts = word.copy()
        starts[1:] &= ~word[:-1] | first[1:-1]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | first[1:-1]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.doc = np.searchsorted(bounds, self.start, side="right") - 1
        size = 1 << max(20, int(len(data)).bit_length())
        self._up, self._down = _powers(size)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUE[fold[data]] * self._up[: len(data)], out=self._sums[1:])
        self.hash = self.span_hash(self.start, self.end)

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of the folded bytes in [start, end), independent of the place."""
        raw = (self._sums[end] - self._sums[start]) * self._down[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))

    def doc_bounds(self) -> np.ndarray:
        """Bounds of each text's words."""
        return np.searchsorted(self.doc, np.arange(self.n_docs + 1))


def text_slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of an Arrow string column with their bytes and bounds, about ``max_bytes`` at a time; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + max_bytes, side="right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
