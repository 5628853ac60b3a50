"""Harmonic packing of token sequences.

A document of n tokens (at most the capacity C) belongs to the reciprocal class k = C // n: its length
lies in (C / (k + 1), C / k], so a sequence of class k takes exactly k such documents. Longer documents
have to be cut anyway; they form a stream that fills the room left in the class sequences and then
whole sequences of its own. If the stream runs dry, the sequences with the most room are dissolved
into it. Every worker packs its own rows, in groups of some million tokens, with nothing shared; a
group leaves at most one sequence that isn't full.

Edge cases: a null or empty text has one token, the end id. Repeated rows are documents of their own.
An empty table has no sequences. Other columns don't matter.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released, text_slices
from .tokens import VOCABULARY, encoder

CAPACITY = 2048
END_ID = 1
GROUP_TOKENS = 4_000_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padded_to long"


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length); every token lies in exactly one of them."""
    classes: dict[int, list[int]] = defaultdict(list)
    stream: deque[tuple[int, int, int]] = deque()
    for i, n in enumerate(lengths):
        if n > capacity:
            stream.append((i, 0, n))
        elif n:
            classes[capacity // n].append(i)
    bins = [[(i, 0, lengths[i]) for i in members[a : a + k]] for k, members in sorted(classes.items()) for a in range(0, len(members), k)]
    room = [capacity - sum(n for _, _, n in b) for b in bins]
    waiting = deque(sorted(range(len(bins)), key=lambda b: (room[b], b)))
    left = sum(n for _, _, n in stream)

    def take(want: int) -> list[tuple[int, int, int]]:
        out = []
        while want and stream:
            i, at, n = stream.popleft()
            cut = min(n, want)
            out.append((i, at, cut))
            if cut < n:
                stream.appendleft((i, at + cut, n - cut))
            want -= cut
        return out

    done = []
    while waiting:
        b = waiting[0]
        if room[b] <= left:
            waiting.popleft()
            left -= room[b]
            done.append(bins[b] + take(room[b]))
        else:
            loose = bins[waiting.pop()]
            stream.extend(loose)
            left += sum(n for _, _, n in loose)
    while stream:
        done.append(take(capacity))
    return done


def padded(length: int, capacity: int = CAPACITY) -> int:
    return length if length & (length - 1) == 0 else capacity


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents in their sequences; ``with_ids`` adds each piece's ids (little-endian unsigned 32-bit)."""

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        sequence = TaskContext.get().partitionId() << 36
        names, flat, lengths, tokens = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            ids = np.concatenate(flat)
            flat.clear()
            first = np.concatenate(([0], np.cumsum(lengths))).tolist()
            rows: list[list] = [[] for _ in range(8 + with_ids)]
            for content in pack(lengths, capacity):
                offset, to = 0, padded(sum(n for _, _, n in content), capacity)
                for i, at, n in content:
                    raw = ids[first[i] + at : first[i] + at + n].tobytes()
                    for out, x in zip(rows, (names[i], at, n, zlib.crc32(raw), lengths[i], sequence, offset, to, raw)):
                        out.append(x)
                    offset += n
                sequence += 1
            columns = [pa.array(x, pa.int64()) for x in rows[:8]] + [pa.array(x, pa.binary()) for x in rows[8:]]
            return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids)

        for part in text_slices(batches, "text"):
            ids, bounds = encode(part.column(1))
            names += part.column(0).to_pylist()
            lengths += (np.diff(bounds) + 1).tolist()
            flat.append(np.insert(ids, bounds[1:], np.uint32(end_id)).astype("<u4"))
            tokens += len(flat[-1])
            if tokens >= GROUP_TOKENS:
                done = flush()
                names, flat, lengths, tokens = [], [], [], 0
                yield done
                del done
        if names:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(released(packed), PIECES + ", ids binary" * with_ids)


def op6_harmonic_pack(spark, sf_dir: str) -> DataFrame:
    return pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
