"""Shared folders and array helpers of the corpus operators."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import itertools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of ``[\x20\x09-\x0D]``.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True

_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors all see, below ``spark.checkpoint.dir``.

    Only where that setting is absent and Spark runs in one process (tests) a temporary folder takes its place:
    on a cluster each machine would write to a disk of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='dwellspan-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/dwellspan/{name}-{uuid.uuid4().hex}"


_tables = itertools.count(1)
COLLECT_EVERY = 3  # tables


def written(df: DataFrame, name: str, collect: bool = False) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage and survives lost executors.

    After every few tables (``collect``: after this one) the driver's JVM is asked to collect garbage: Spark drops the shuffle files of ended
    jobs on the executors only once their handles are collected, and the driver's heap doesn't grow meanwhile."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    if next(_tables) % COLLECT_EVERY == 0 or collect:
        ended_jobs_freed(spark)
    return spark.read.schema(df.schema).parquet(path)


def ended_jobs_freed(spark: SparkSession) -> None:
    """Asks the driver's JVM to collect garbage. The latest job is often still held by the events of its end, so its own shuffle
    files may go only if this is called after another job."""
    spark.sparkContext._jvm.System.gc()


def released(run):
    """``run``, a generator over batches, for mapInArrow: as its task ends, freed memory goes back to the system. Python workers
    live on with the next stages, whose peaks would otherwise lie on top of what this one has let go."""

    def lean(batches):
        yield from run(batches)
        _given_back()

    return lean


def released_groups(of_group):
    """The same for applyInPandas: after each group."""

    def lean(group):
        out = of_group(group)
        del group
        _given_back()
        return out

    return lean


def _given_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only glibc has it
    if trim:
        trim(0)


def mixed(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX_1
    x ^= x >> np.uint64(27)
    x *= _MIX_2
    x ^= x >> np.uint64(31)
    return x


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and each row's bounds in them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string() if not pa.types.is_binary(column.type) else pa.large_binary())
    if column.null_count:
        column = pc.fill_null(column, pa.scalar("" if pa.types.is_large_string(column.type) else b"", column.type))
    bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


@functools.lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _BASE_INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_PLACES = 64
_PLACE_VALUES = np.random.Generator(np.random.PCG64(20240301)).integers(0, 1 << 64, _PLACES * 256, dtype=np.uint64)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte ranges, none of them empty: the sum of a random value for each pair of place and byte.

    Unlike a polynomial modulo a power of two it has no texts that are known to collide. It still is a hash:
    what must be equal for sure is compared or told apart by a cryptographic digest."""
    sizes = ends - starts
    if not len(sizes):
        return np.zeros(0, np.uint64)
    head = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum())) - np.repeat(head, sizes)
    values = _PLACE_VALUES[((place & (_PLACES - 1)) << 8) | data[ranges(starts, sizes)]]
    far = np.flatnonzero(place >= _PLACES)
    if len(far):
        values[far] = mixed(values[far] + (place[far] // _PLACES).astype(np.uint64) * _BASE)
    return mixed(np.add.reduceat(values, head) + sizes.astype(np.uint64) * _BASE)


def text_digests(data: np.ndarray, bounds: np.ndarray, size: int = 16) -> np.ndarray:
    """A cryptographic digest of each row's bytes: rows of ``size`` // 8 64-bit numbers."""
    raw, edges = data.tobytes(), bounds.tolist()
    return np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=size).digest() for a, b in zip(edges, edges[1:])), "<u8").reshape(-1, size // 8)


class SpanHasher:
    """64-bit polynomial hashes of any byte ranges, from one prefix sum.

    Only to spread or to find: some texts are known to collide (Thue-Morse words of 1024 letters and more)."""

    def __init__(self, data: np.ndarray, seed: int = 0):
        n = len(data)
        up, self._down = _powers(1 << max(10, int(n).bit_length()))
        values = _BYTE_VALUES if not seed else mixed(_BYTE_VALUES + np.uint64(seed)) | np.uint64(1)
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * up[:n], dtype=np.uint64, out=self._sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self._sums[ends] - self._sums[starts]) * self._down[starts] + (ends - starts).astype(np.uint64))

    def fixed(self, length: int) -> np.ndarray:
        """The hashes of all windows of one length."""
        n = len(self._sums) - length
        return mixed((self._sums[length:] - self._sums[:n]) * self._down[:n]) if n > 0 else np.zeros(0, np.uint64)


def word_spans(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs without blanks, and the row of each; runs don't cross rows."""
    solid = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], solid[:-1])) if len(data) else solid
    after = np.concatenate((solid[1:], [False])) if len(data) else solid
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(bounds, starts, "right") - 1


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The integers of all ``[start, start + length)`` in turn."""
    total = int(lengths.sum())
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, n = starts[full], lengths[full]
    if not len(s):
        return out[:0]
    out[0] = s[0]
    at = np.cumsum(n)[:-1]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def text_slices(batches, column: str, limit: int = 2 << 20):
    """Arrow batches cut into slices of about ``limit`` text bytes (single longer texts stay whole)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // limit
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
