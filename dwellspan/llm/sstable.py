"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order: data blocks of prefix-compressed entries, then a
sparse index (each block's first key, place and size), a Bloom filter over the keys and a footer of
fixed size at the end. ``ShardReader.get`` asks the filter, finds the block by binary search in the
index and reads only that block.

Keys are the ids as big-endian 64-bit integers with the sign bit flipped, so bytes sort as numbers.
A null id has the empty key and sorts first. Rows with equal ids are separate entries, in order of
text. A null text is an empty one: it has the end id alone. Shards without documents aren't
written; an empty table has none and gives an empty result.

Shards lie in the folder that driver and executors share. A task names its file by its attempt, and
the manifest (one row per shard, itself a table) names the files that count, so lost executors and
repeated tasks leave no half-written shard in use.
"""

from __future__ import annotations

import array
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import mixed, released, shared_folder, text_slices, written
from .tokens import VOCABULARY, encoder

MAGIC = b"DWSST\x00\x00\x01"
FOOTER = struct.Struct("<QQQQQQ8s")  # index at, index bytes, filter at, filter bytes, documents, ids, magic
BLOCK_BYTES = 1 << 16
RESTART = 16  # every so many entries a key is stored whole
BITS_PER_KEY, PROBES = 10, 7
END_ID = 0

SHARD_BYTES = 64 << 20  # a task goes on in a next shard from here

MANIFEST = "shard int, part int, file string, n_docs long, n_ids long, first_key binary, last_key binary"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(buf, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        n |= (b & 0x7F) << shift
        at += 1
        if b < 0x80:
            return n, at
        shift += 7


class Bloom:
    """Blocked by nothing, probed by double hashing of the key's 64-bit mix."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def number(key: bytes) -> int:
        """What the filter knows of a key."""
        return int.from_bytes(key.rjust(8, b"\0"), "big") + len(key) & (1 << 64) - 1

    @staticmethod
    def _probes(numbers: np.ndarray, m: int) -> np.ndarray:
        h = mixed(numbers)
        step = mixed(h) | np.uint64(1)
        return (h[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) % np.uint64(m)

    @classmethod
    def of(cls, numbers: np.ndarray) -> Bloom:
        flags = np.zeros(max(64, -(-len(numbers) * BITS_PER_KEY // 8) * 8), np.uint8)
        for at in range(0, len(numbers), 1 << 16):
            flags[cls._probes(numbers[at : at + (1 << 16)], len(flags)).ravel()] = 1
        return cls(np.packbits(flags))

    def may_have(self, key: bytes) -> bool:
        at = self._probes(np.array([self.number(key)], np.uint64), len(self.bits) * 8)[0]
        return bool((self.bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8)) & 1).all())


class ShardWriter:
    """Writes entries in ascending key order to an open binary stream."""

    def __init__(self, out):
        self._out, self._at, self._index = out, 0, []
        self._numbers, self.first_key, self.last_key = array.array("Q"), None, None
        self.n_docs = self.n_ids = 0
        self._press = zstandard.ZstdCompressor(level=1)
        self._open_block()

    def _open_block(self) -> None:
        self._block, self._size, self._entries, self._last = [], 0, 0, b""

    @property
    def n_bytes(self) -> int:
        """Bytes written so far, besides the open block."""
        return self._at

    def _put(self, raw: bytes) -> None:
        self._out.write(raw)
        self._at += len(raw)

    def _close_block(self) -> None:
        if self._entries:
            raw = self._press.compress(b"".join(self._block))
            self._index.append((self._first, self._at, len(raw)))
            self._put(raw + struct.pack("<I", zlib.crc32(raw)))
        self._open_block()

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.last_key is not None and key < self.last_key:
            raise ValueError("keys must ascend")
        shared = 0
        if self._entries % RESTART:
            while shared < min(len(key), len(self._last)) and key[shared] == self._last[shared]:
                shared += 1
        if not self._entries:
            self._first = key
        wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
        value = ids.astype("<u4" if wide else "<u2").tobytes()
        head = _varint(shared) + _varint(len(key) - shared) + _varint(len(ids) << 1 | wide)
        self._block += [head, key[shared:], value]
        self._size += len(head) + len(key) - shared + len(value)
        self._entries += 1
        self._last = self.last_key = key
        self.first_key = key if self.first_key is None else self.first_key
        self._numbers.append(Bloom.number(key))
        self.n_docs += 1
        self.n_ids += len(ids)
        if self._size >= BLOCK_BYTES:
            self._close_block()

    def finish(self) -> None:
        self._close_block()
        index_at = self._at
        self._put(b"".join(_varint(len(k)) + k + _varint(at) + _varint(n) for k, at, n in self._index))
        filter_at = self._at
        self._put(Bloom.of(np.array(self._numbers, np.uint64)).bits.tobytes() if self._numbers else b"")
        self._put(FOOTER.pack(index_at, filter_at - index_at, filter_at, self._at - filter_at, self.n_docs, self.n_ids, MAGIC))


class ShardReader:
    """Reads a seekable binary stream of a whole shard."""

    def __init__(self, stream, size: int):
        self._in = stream
        stream.seek(size - FOOTER.size)
        index_at, index_n, filter_at, filter_n, self.n_docs, self.n_ids, magic = FOOTER.unpack(stream.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard")
        stream.seek(index_at)
        raw, at = stream.read(index_n), 0
        self._first, self._place = [], []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self._first.append(raw[at : at + n])
            place, at = _read_varint(raw, at + n)
            size, at = _read_varint(raw, at)
            self._place.append((place, size))
        stream.seek(filter_at)
        self._bloom = Bloom(np.frombuffer(stream.read(filter_n), np.uint8))
        self._unpress = zstandard.ZstdDecompressor()

    def block(self, n: int) -> Iterator[tuple[bytes, np.ndarray]]:
        at, size = self._place[n]
        self._in.seek(at)
        raw = self._in.read(size + 4)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("damaged block")
        buf, at, key = self._unpress.decompress(raw[:-4]), 0, b""
        while at < len(buf):
            shared, at = _read_varint(buf, at)
            rest, at = _read_varint(buf, at)
            head, at = _read_varint(buf, at)
            key = key[:shared] + buf[at : at + rest]
            at += rest
            kind = np.dtype("<u4" if head & 1 else "<u2")
            yield key, np.frombuffer(buf, kind, head >> 1, at)
            at += (head >> 1) * kind.itemsize

    def __iter__(self):
        for n in range(len(self._place)):
            yield from self.block(n)

    def get(self, key: bytes) -> list[np.ndarray]:
        """All values under the key."""
        import bisect

        if not self._place or not self._bloom.may_have(key):
            return []
        found = []
        for n in range(max(0, bisect.bisect_left(self._first, key) - 1), len(self._first)):
            if self._first[n] > key:
                break
            found += [ids for k, ids in self.block(n) if k == key]
        return found


def write_shards(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes all texts, writes the shards and returns their manifest. Tasks are as many as the session's shuffle partitions; each goes on
    in a next shard at ``shard_bytes``, so shards are bounded whatever the data."""
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "shards")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pyarrow.fs.FileSystem.from_uri(folder)[0].create_dir(pyarrow.fs.FileSystem.from_uri(folder)[1])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, path = pyarrow.fs.FileSystem.from_uri(folder)
        name = f"{path}/shard-{task.partitionId():06d}-{{:04d}}-{task.taskAttemptId()}.sst".format
        out, writer, done = None, None, 0
        encode = encoder(vocabulary).encode

        def close() -> pa.RecordBatch:
            writer.finish()
            out.close()
            row = (task.partitionId(), done, name(done), writer.n_docs, writer.n_ids, writer.first_key, writer.last_key)
            types = (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [c.split()[0] for c in MANIFEST.split(", ")])

        for part in text_slices(batches, "text"):
            ids, bounds = encode(part.column(1))
            for k, doc_id in enumerate(part.column(0).to_pylist()):
                if out is None:
                    out = store.open_output_stream(name(done))
                    writer = ShardWriter(out)
                writer.add(key_of(doc_id), np.append(ids[bounds[k] : bounds[k + 1]], np.uint32(end_id)))
                if writer.n_bytes >= shard_bytes:
                    yield close()
                    out, done = None, done + 1
        if out is not None:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(released(write), MANIFEST).withColumn("folder", F.lit(folder)), "manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian unsigned 32-bit) of all documents, from the files."""
    spark = manifest.sparkSession
    before = W.orderBy("shard", "part").rowsBetween(W.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                store, _ = pyarrow.fs.FileSystem.from_uri(row["folder"])
                info = store.get_file_info(row["file"])
                start, rows, size = row["start"], [], 0
                with store.open_input_file(row["file"]) as stream:
                    for key, ids in ShardReader(stream, info.size):
                        rows.append((id_of(key), start, len(ids), ids.astype("<u4").tobytes()))
                        start, size = start + len(ids), size + 4 * len(ids)
                        if size > 4 << 20:
                            yield _rows(rows)
                            rows, size = [], 0
                if rows:
                    yield _rows(rows)

    return placed.repartition(n, "file").mapInArrow(released(read), "doc_id long, start long, n_tokens long, ids binary")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c, d = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])


def look_up(manifest: DataFrame, doc_ids: list[int]) -> DataFrame:
    """doc_id, ids of a short list of documents: only shards whose range of keys has one of them are opened, and read by binary search."""
    keys = [(i, key_of(i)) for i in doc_ids]
    wanted = F.array(*[F.lit(key) for _, key in keys]) if keys else F.array().cast("array<binary>")
    manifest = manifest.where(F.exists(wanted, lambda k: (F.col("first_key") <= k) & (k <= F.col("last_key"))))

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for folder, name in zip(frame["folder"], frame["file"]):
                store, _ = pyarrow.fs.FileSystem.from_uri(folder)
                with store.open_input_file(name) as stream:
                    shard = ShardReader(stream, store.get_file_info(name).size)
                    found = [(i, ids.tolist()) for i, key in keys for ids in shard.get(key)]
                yield pd.DataFrame(found, columns=["doc_id", "ids"])

    return manifest.repartition("file").mapInPandas(find, "doc_id long, ids array<long>")


def op8_token_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_shards(write_shards(docs)).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
