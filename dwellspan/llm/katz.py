"""Language-model scores by Katz backoff with Good-Turing discounts.

A table of n-grams is learned level by level and lies in buckets: words by their text, longer n-grams by (history,
word), where a history is the number of an n-gram one shorter. Texts are tokenised once, in chunks that each
know their own distinct n-grams; every level takes these to the buckets with their counts, where they are summed
exactly over all chunks, and the answers go back to the chunks that asked. A token's probability is its
discounted n-gram share where that n-gram was learned, and else the backoff weight of its history
times its probability under the next shorter history, down to single words.

The weight of a history is (what its discounts leave) / (1 - shorter probabilities of the words learned
after it), so all probabilities after a history sum to 1. Counts up to ``KEPT`` are discounted; where the counts of
counts give no discount between 0 and 1 for one of them, fewer are, and if none can be, counts of 1 by
one half. A history whose counts are all too large to be discounted counts one token more. What words leave
goes to the unknown word. Histories that occur over ``HOT`` times are dealt to several buckets by word.

Edge cases: a null or blank text has only the end token. A row without an id is never held out. Rows with equal ids are
texts of their own. Without training rows all tokens are unknown, with probability 1. An empty table gives
an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANK, mixed, ranges, span_hashes, text_bytes, text_slices, word_spans, written

ORDER = 2  # tokens of the longest n-grams
KEPT = 5  # largest count that is discounted
CHUNK = 9 << 20  # text bytes, unless one text has more
WORD_BUCKET = 24 << 20  # text bytes for each bucket of words
BUCKET = 1 << 21  # tokens for each bucket of longer n-grams
HOT = 1 << 20
LEAST_BUCKETS = 16
END = 1  # number of the end token, and as a history of the text's start; 0 is an unknown word


def packed(values: np.ndarray, ascending: bool = False) -> bytes:
    """Whole numbers as narrow as they go, byte by byte, compressed; ascending ones by their differences."""
    v = np.asarray(values, np.int64)
    if ascending:
        v = np.diff(v, prepend=0)
        v = (v << 1) ^ (v >> 63)
    most = int(v.max(initial=0))
    width = next(w for w in (1, 2, 4, 8) if w == 8 or most < 1 << (8 * w))
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(v.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes(), 1)


def unpacked(blob: bytes, ascending: bool = False) -> np.ndarray:
    width = blob[0]
    planes = np.frombuffer(zstandard.decompress(blob[1:]), np.uint8).reshape(width, -1)
    v = np.ascontiguousarray(planes.T).view(f"<u{width}")[:, 0].astype(np.int64)
    if ascending:
        v = np.cumsum((v >> 1) ^ -(v & 1))
    return v


def discounts(counts: list[int]) -> np.ndarray:
    """Factors for the counts 0 to ``KEPT`` + 1 (the last stands for all larger ones) from the numbers of n-grams with counts 1 to ``KEPT`` + 1."""
    n = [0, *counts]
    for k in range(KEPT, 0, -1):
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        if common < 1 and all(n[1 : k + 1]):
            d = [((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) for r in range(1, k + 1)]
            if all(0 < x < 1 for x in d):
                return np.array([1.0, *d] + [1.0] * (KEPT + 1 - k))
    return np.array([1.0, 0.5] + [1.0] * KEPT)


def _kept(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return d[np.minimum(c, KEPT + 1)]


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


_BIN, _LONGS = pa.binary(), pa.list_(pa.int64())
_CODED = "chunk long, ids array<long>, held array<boolean>, lengths array<long>, tokens binary, learned long, words array<struct<bucket:int,words:binary,lengths:binary,counts:binary>>"


def _coded(n_buckets: int):
    """Texts as chunks: their tokens as numbers of the chunk's distinct words, and these words by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lower = np.arange(256, dtype=np.uint8)
        lower[0x41:0x5B] += 32
        for k, part in enumerate(text_slices(batches, "text", CHUNK)):
            data, bounds = text_bytes(part.column(1))
            data = lower[data]
            starts, ends, row = word_spans(data, bounds)
            each = np.bincount(row, minlength=part.num_rows)
            held = part.column(2).to_numpy(zero_copy_only=False)
            edges = np.concatenate(([0], np.cumsum(ends - starts)))
            solid = data[~BLANK[data]]
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(solid)]).dictionary_encode()
            words, bounds = text_bytes(coded.dictionary)
            token = coded.indices.to_numpy()
            counts = np.bincount(token[np.repeat(~held, each)], minlength=len(bounds) - 1)
            mark = span_hashes(words, bounds[:-1], bounds[1:])
            bucket = (mark >> np.uint64(32)) % np.uint64(n_buckets)
            order = np.lexsort((mark, bucket))
            at = np.empty(len(order), np.int64)
            at[order] = np.arange(len(order))
            size = np.diff(bounds)
            deal = []
            for b, own in zip(*_runs(bucket[order])):
                own = order[own]
                text = words[ranges(bounds[own], size[own])].tobytes()
                deal.append({"bucket": int(b), "words": zstandard.compress(text, 1), "lengths": packed(size[own]), "counts": packed(counts[own])})
            chunk = (int(part.column(3)[0].as_py()) << 24) + k
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk]),
                    pa.array([part.column(0).to_pylist()], _LONGS),
                    pa.array([held.tolist()], pa.list_(pa.bool_())),
                    pa.array([each.tolist()], _LONGS),
                    pa.array([packed(at[token])], _BIN),
                    pa.array([int((each + 1)[~held].sum())]),
                    pa.array([deal], pa.list_(pa.struct([("bucket", pa.int32()), ("words", _BIN), ("lengths", _BIN), ("counts", _BIN)]))),
                ],
                [c.split()[0] for c in "chunk long, ids, held, lengths, tokens, learned, words".split(", ")],
            )

    return run


def _runs(values: np.ndarray) -> tuple[np.ndarray, list[slice]]:
    """Distinct values of a sorted array and where each lies."""
    head = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1]))) if len(values) else np.zeros(0, np.int64)
    return values[head], [slice(a, b) for a, b in zip(head.tolist(), [*head[1:].tolist(), len(values)])]


_TABLE = "bucket int, facts array<long>, keys array<binary>, answers array<struct<chunk:long,numbers:binary,counts:binary>>"
_ANSWERS = pa.list_(pa.struct([("chunk", pa.int64()), ("numbers", _BIN), ("counts", _BIN)]))


def _facts(counts: np.ndarray) -> list[int]:
    """Sum and number of the counts over 0, then how many are 1, 2, ... ``KEPT`` + 1."""
    return [int(counts.sum()), int((counts > 0).sum()), *np.bincount(np.minimum(counts, KEPT + 2), minlength=KEPT + 3)[1 : KEPT + 2].tolist()]


def _bucket_row(bucket: int, counts: np.ndarray, keys: list[bytes], answers: list[dict]) -> pa.Table:
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "facts": pa.array([_facts(counts)], _LONGS), "keys": pa.array([keys], pa.list_(_BIN)), "answers": pa.array([answers], _ANSWERS)})


def _words(table: pa.Table) -> pa.Table:
    """The words of a bucket with their counts over all chunks; each chunk's words as places among them."""
    rows = table.sort_by("chunk").to_pylist()
    text = np.frombuffer(b"".join(zstandard.decompress(r["words"]) for r in rows), np.uint8)
    sizes = [unpacked(r["lengths"]) for r in rows]
    edges = np.concatenate(([0], np.cumsum(np.concatenate(sizes))))
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(text)]).dictionary_encode()
    words, bounds = text_bytes(coded.dictionary)
    order = np.argsort(span_hashes(words, bounds[:-1], bounds[1:]), kind="stable")
    at = np.empty(len(order), np.int64)
    at[order] = np.arange(len(order))
    place, size = at[coded.indices.to_numpy()], np.diff(bounds)[order]
    counts = np.zeros(len(order), np.int64)
    np.add.at(counts, place, np.concatenate([unpacked(r["counts"]) for r in rows]))
    stops = np.cumsum([len(s) for s in sizes]).tolist()
    answers = [{"chunk": r["chunk"], "numbers": packed(place[a:b], True), "counts": packed(counts[place[a:b]])} for r, a, b in zip(rows, [0, *stops], stops)]
    return _bucket_row(rows[0]["bucket"], counts, [zstandard.compress(words[ranges(bounds[order], size)].tobytes(), 1), packed(size), packed(counts)], answers)


def _counted(table: pa.Table) -> pa.Table:
    """The n-grams of a bucket with their counts over all chunks; each chunk's n-grams as places among them."""
    rows = table.sort_by("chunk").to_pylist()
    history, word = (np.concatenate([unpacked(r["keys"][k], k == 0) for r in rows]) for k in (0, 1))
    order = np.lexsort((word, history))
    new = np.ones(len(order), bool)
    new[1:] = (history[order][1:] != history[order][:-1]) | (word[order][1:] != word[order][:-1])
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    first = order[new]
    counts = np.zeros(len(first), np.int64)
    np.add.at(counts, place, np.concatenate([unpacked(r["keys"][2]) for r in rows]))
    keys = [packed(history[first], True), packed(word[first]), packed(counts)]
    for k in (3, 4, 5):  # the history's count, and the shorter n-gram's count and history: the same wherever it was learned
        value = np.concatenate([unpacked(r["keys"][k]) for r in rows])
        most = np.zeros(len(first), np.int64)
        np.maximum.at(most, place, value)
        keys.append(packed(most))
    stops = np.cumsum([len(unpacked(r["keys"][1])) for r in rows]).tolist()
    answers = [{"chunk": r["chunk"], "numbers": packed(place[a:b], True), "counts": b""} for r, a, b in zip(rows, [0, *stops], stops)]
    return _bucket_row(rows[0]["bucket"], counts, keys, answers)


class _Level:
    """What the driver knows of a level: discounts and number of buckets, and of words the number of tokens and the unknown word's share."""

    def __init__(self, table: DataFrame, n_buckets: int, hot: int, ends: int | None = None):
        sums = table.agg(*(F.sum(F.col("facts")[k]).alias(f"f{k}") for k in range(KEPT + 3))).first()
        total, distinct, *counts = (int(x or 0) for x in sums)
        if ends is not None:  # the end token is a word too
            total, distinct = total + ends, distinct + (ends > 0)
            if 0 < ends <= KEPT + 1:
                counts[ends - 1] += 1
        self.n_buckets, self.hot, self.total, self.distinct, self.ends = n_buckets, hot, total, distinct, ends
        self.d = discounts(counts)
        left = sum((1 - self.d[r]) * r * counts[r - 1] for r in range(1, KEPT + 1))
        self.bottom = total + (0 if left else 1)
        self.unknown = left / total if left else 1 / self.bottom


def _shares(row: dict, level: _Level, lower: _Level):
    """Of a bucket: histories' first rows, counts and the two sums that make their weights."""
    history = unpacked(row["keys"][0], True)
    word, count, of, less, less_of = (unpacked(row["keys"][k]) for k in range(1, 6))
    head = np.flatnonzero(np.concatenate(([True], history[1:] != history[:-1])))
    left = np.add.reduceat((1 - _kept(count, level.d)) * count, head) / of[head]
    seen = np.add.reduceat(np.where(count > 0, _kept(less, lower.d) * less / np.maximum(less_of, 1), 0.0), head)
    return history, word, count, of, head, left, seen


def _hot_sums(level: _Level, lower: _Level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                history, _, _, of, head, left, seen = _shares(row, level, lower)
                hot = of[head] > level.hot
                yield pa.RecordBatch.from_arrays([pa.array(np.full(int(hot.sum()), row["bucket"], np.int32)), pa.array(history[head[hot]]), pa.array(left[hot]), pa.array(seen[hot])], ["bucket", "history", "left", "seen"])

    return run


_ANSWER = "chunk long, level int, bucket int, numbers binary, counts binary, more binary, weights binary"
_ANSWER_ARROW = pa.schema([("chunk", pa.int64()), ("level", pa.int32()), ("bucket", pa.int32()), ("numbers", _BIN), ("counts", _BIN), ("more", _BIN), ("weights", _BIN)])


def _answers(level: _Level, lower: _Level, k: int, last: bool):
    """To each chunk its n-grams' counts, whether their history counts one token more, and the histories' weights where an n-gram wasn't learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                history, _, count, of, head, left, seen = _shares(row, level, lower)
                for h in row["hot"] or []:
                    at = np.searchsorted(history[head], h["history"])
                    left[at], seen[at] = h["left"], h["seen"]
                more = left <= 0
                weight = np.where(more, 1 / (of[head] + 1), left) / (1 - seen)
                own = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(history))))
                out = []
                for a in row["answers"]:
                    place = unpacked(a["numbers"], True)
                    c = count[place]
                    out.append((a["chunk"], k, row["bucket"], b"" if last else a["numbers"], packed(c), packed(more[own[place]]), zstandard.compress(weight[own[place[c == 0]]].tobytes(), 1)))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _ANSWER_ARROW.types)], schema=_ANSWER_ARROW)

    return run


class _Chunk:
    """A chunk's tokens with what the levels answered so far; ``level`` goes up one by one."""

    def __init__(self, coded: dict, answers: list[dict], words: _Level):
        self.answers = answers
        rows = self._of(1)
        number = np.concatenate([np.zeros(0, np.int64), *(np.where(c > 0, END + 1 + unpacked(r["numbers"], True) * words.n_buckets + r["bucket"], 0) for r in rows for c in [unpacked(r["counts"])])])
        count = np.concatenate([np.zeros(0, np.int64), *(unpacked(r["counts"]) for r in rows)])
        token, self.lengths = unpacked(coded["tokens"]), np.array(coded["lengths"], np.int64) + 1
        self.stop = np.cumsum(self.lengths) - 1
        self.start = self.stop - self.lengths + 1
        self.learns = np.repeat(~np.array(coded["held"], bool), self.lengths)
        # Words by rank of their numbers; the end has a place of its own.
        self.numbers, rank = np.unique(np.append(number, END), return_inverse=True)
        rank = rank.astype(np.int32)
        inner = np.ones(len(self.learns), bool)
        inner[self.stop] = False
        self.rank, self.count = np.full(len(inner), rank[-1], np.int32), np.full(len(inner), words.ends, np.int64)
        self.rank[inner], self.count[inner] = rank[token], count[token]
        self.score = np.log10(np.where(self.count > 0, _kept(self.count, words.d) * self.count / words.bottom, words.unknown))
        # Of the level above: each token's history (rank among numbers) and its count, and of its shorter n-gram count and history's count.
        self.h_numbers, self.h = self.numbers, np.append(rank[-1], self.rank[:-1])
        self.h_count = np.append(words.ends, self.count[:-1])
        self.h[self.start], self.h_count[self.start] = rank[-1], words.ends
        self.less, self.less_of = self.count, np.full(len(inner), words.bottom)
        self.known = (self.h_numbers[self.h] != 0) & (self.h_count > 0)

    def _of(self, level: int) -> list[dict]:
        return sorted((r for r in self.answers if r["level"] == level), key=lambda r: r["bucket"])

    def keys(self, n_buckets: int, hot: int):
        """Distinct n-grams of the next level in order of buckets, histories and words."""
        self.at = np.flatnonzero(self.known).astype(np.int32)
        code = self.h[self.at].astype(np.int64) * len(self.numbers) + self.rank[self.at]
        code, place = np.unique(code, return_inverse=True)
        self.place = place.astype(np.int32)
        history, word = self.h_numbers[code // len(self.numbers)], self.numbers[code % len(self.numbers)]
        of = np.zeros(len(code), np.int64)
        of[self.place] = self.h_count[self.at]
        parts = np.maximum(1, -(-of // hot)).astype(np.uint64)
        bucket = (mixed(mixed(history.astype(np.uint64)) + mixed(word.astype(np.uint64)) % parts) >> np.uint64(20)) % np.uint64(n_buckets)
        self.order = np.argsort(bucket, kind="stable")
        return bucket.astype(np.int64), history, word, of

    def emitted(self, n_buckets: int, hot: int) -> list[tuple[int, list[bytes]]]:
        bucket, history, word, of = self.keys(n_buckets, hot)
        learned = np.bincount(self.place[self.learns[self.at]], minlength=len(word))
        less, less_of = np.zeros(len(word), np.int64), np.zeros(len(word), np.int64)
        less[self.place], less_of[self.place] = self.less[self.at], self.less_of[self.at]
        less[learned == 0] = less_of[learned == 0] = 0
        out = []
        for b, own in zip(*_runs(bucket[self.order])):
            own = self.order[own]
            out.append((int(b), [packed(history[own], True), *(packed(x[own]) for x in (word, learned, of, less, less_of))]))
        return out

    def answered(self, k: int, level: _Level) -> None:
        """Takes level ``k``'s answers in; what follows stands for the level above."""
        self.keys(level.n_buckets, level.hot)
        rows = self._of(k)
        count, more, weight = np.zeros(len(self.order), np.int64), np.zeros(len(self.order), np.int64), np.ones(len(self.order))
        c = np.concatenate([np.zeros(0, np.int64), *(unpacked(r["counts"]) for r in rows)])
        count[self.order], more[self.order] = c, np.concatenate([np.zeros(0, np.int64), *(unpacked(r["more"]) for r in rows)])
        weight[self.order[c == 0]] = np.concatenate([np.zeros(0), *(np.frombuffer(zstandard.decompress(r["weights"]), np.float64) for r in rows)])
        own, of = count[self.place], self.h_count[self.at] + more[self.place]
        self.score[self.at] = np.where(own > 0, np.log10(np.maximum(_kept(own, level.d) * own, 1e-300) / of), np.log10(weight[self.place]) + self.score[self.at])
        if any(r["numbers"] for r in rows):
            number = np.zeros(len(self.order), np.int64)
            number[self.order] = np.concatenate([END + 1 + unpacked(r["numbers"], True) * level.n_buckets + r["bucket"] for r in rows])
            self.h_numbers, rank = np.unique(np.append(np.where(count > 0, number, 0), 0), return_inverse=True)
            rank = rank.astype(np.int32)
            before = np.full(len(self.h), rank[-1], np.int32)  # the n-gram that ends at each token; 0 if it wasn't learned
            before[self.at] = rank[self.place]
            of_before = np.zeros(len(self.h), np.int64)
            of_before[self.at] = own
            self.less, self.less_of = of_before, np.zeros(len(self.h), np.int64)
            self.less_of[self.at] = of
            self.h, self.h_count = np.append(rank[-1], before[:-1]), np.append(0, of_before[:-1])
            self.h[self.start], self.h_count[self.start] = rank[-1], 0
            self.known = self.h_numbers[self.h] != 0


def _chunk(left: pa.Table, right: pa.Table, levels: list[_Level]) -> tuple[dict, _Chunk] | None:
    if not left.num_rows:
        return None
    coded = left.to_pylist()[0]
    chunk = _Chunk(coded, right.to_pylist(), levels[0])
    for k, level in enumerate(levels[1:], 2):
        chunk.answered(k, level)
    return coded, chunk


def _emit(levels: list[_Level], n_buckets: int, hot: int):
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("keys", pa.list_(_BIN))])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (found := _chunk(left, right, levels)):
            return schema.empty_table()
        coded, chunk = found
        out = chunk.emitted(n_buckets, hot)
        return pa.Table.from_arrays([pa.array([coded["chunk"]] * len(out), pa.int64()), pa.array([b for b, _ in out], pa.int32()), pa.array([k for _, k in out], pa.list_(_BIN))], schema=schema)

    return run


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(levels: list[_Level]):
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), *((n, pa.int64()) for n in ("n_tokens", "n_known", "train_tokens")), ("base_score", pa.float64()), ("score", pa.float64())])
    words = levels[0]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not (found := _chunk(left, right, levels)):
            return schema.empty_table()
        coded, chunk = found
        base = np.log10((chunk.count + 1) / (words.total + words.distinct + 1))
        each = lambda x: np.add.reduceat(x, chunk.start)
        return pa.Table.from_arrays(
            [
                pa.array(coded["ids"], pa.int64()),
                pa.array(coded["held"], pa.bool_()),
                pa.array(chunk.lengths),
                pa.array(each((chunk.count > 0).astype(np.int64))),
                pa.array(np.full(len(chunk.lengths), words.total, np.int64)),
                pa.array(each(base)),
                pa.array(each(chunk.score)),
            ],
            schema=schema,
        )

    return run


class Model:
    """The levels' tables, as buckets: ``words()`` and ``ngrams(k)`` show them as rows."""

    def __init__(self, coded: DataFrame, n_buckets: int, hot: int):
        self.hot, self.coded, self.tables, self.levels, self.answers = hot, coded, [], [], None
        dealt = coded.select("chunk", F.inline("words")).groupBy("bucket").applyInArrow(_words, _TABLE)
        sums = coded.agg(F.sum(F.size(F.filter("held", lambda h: ~h))), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x)) + F.sum(F.size("ids"))).first()
        self.n_buckets = max(LEAST_BUCKETS, math.ceil((sums[1] or 0) / BUCKET))
        self._add(written(dealt, "words"), n_buckets, int(sums[0] or 0))
        none = F.lit(None).cast("binary")
        self.answers = [self.tables[0].select("bucket", F.inline("answers")).select("chunk", F.lit(1).alias("level"), "bucket", "numbers", "counts", none.alias("more"), none.alias("weights"))]

    def _add(self, table: DataFrame, n_buckets: int, ends: int | None = None) -> None:
        self.tables.append(table)
        self.levels.append(_Level(table, n_buckets, self.hot, ends))

    def _met(self) -> DataFrame:
        answers = self.answers[0]
        for more in self.answers[1:]:
            answers = answers.unionByName(more)
        return self.coded.drop("words").groupBy("chunk").cogroup(answers.groupBy("chunk"))

    def grow(self, last: bool) -> None:
        """Learns the n-grams one token longer."""
        k = len(self.levels) + 1
        keys = self._met().applyInArrow(_emit(list(self.levels), self.n_buckets, self.hot), "chunk long, bucket int, keys array<binary>")
        self._add(written(keys.groupBy("bucket").applyInArrow(_counted, _TABLE), f"ngrams-{k}"), self.n_buckets)
        level, lower, table = self.levels[-1], self.levels[-2], self.tables[-1]
        parts = written(table.select("bucket", "keys").mapInArrow(_hot_sums(level, lower), "bucket int, history long, left double, seen double"), "hot")
        sums = parts.groupBy("history").agg(F.sum("left").alias("left"), F.sum("seen").alias("seen"))
        hot = parts.select("bucket", "history").join(sums, "history").groupBy("bucket").agg(F.collect_list(F.struct("history", "left", "seen")).alias("hot"))
        told = table.select("bucket", "keys", "answers").join(hot, "bucket", "left").select("bucket", "keys", "answers", "hot")
        self.answers.append(told.mapInArrow(_answers(level, lower, k, last), _ANSWER))

    def scored(self) -> DataFrame:
        return self._met().applyInArrow(_scored(list(self.levels)), _SCORE)

    def words(self) -> DataFrame:
        """number, word, count of all words; those with count 0 are only in texts that were held out."""
        n = self.levels[0].n_buckets

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    text, size = zstandard.decompress(row["keys"][0]), unpacked(row["keys"][1])
                    edges = np.concatenate(([0], np.cumsum(size)))
                    word = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(edges), pa.py_buffer(text)]).cast(pa.large_string()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(END + 1 + np.arange(len(size)) * n + row["bucket"]), word, pa.array(unpacked(row["keys"][2]))], ["number", "word", "count"])

        return self.tables[0].select("bucket", "keys").mapInArrow(run, "number long, word string, count long")

    def ngrams(self, k: int) -> DataFrame:
        """number, history, word, count of the learned n-grams of ``k`` tokens."""
        n = self.levels[k - 1].n_buckets

        def run(batches):
            for batch in batches:
                for row in batch.to_pylist():
                    count = unpacked(row["keys"][2])
                    on = count > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((END + 1 + np.arange(len(count)) * n + row["bucket"])[on]), pa.array(unpacked(row["keys"][0], True)[on]), pa.array(unpacked(row["keys"][1])[on]), pa.array(count[on])],
                        ["number", "history", "word", "count"],
                    )

        return self.tables[k - 1].select("bucket", "keys").mapInArrow(run, "number long, history long, word long, count long")


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, hot: int = HOT) -> Model:
    text = F.col(text_col)
    n_bytes = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    n_buckets = max(LEAST_BUCKETS, math.ceil(n_bytes / WORD_BUCKET))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.cast("string").alias("text"), held_out(id_col).alias("held"), F.spark_partition_id().cast("long").alias("part"))
    model = Model(written(rows.mapInArrow(_coded(n_buckets), _CODED), "chunks"), n_buckets, hot)
    for k in range(2, order + 1):
        model.grow(k == order)
    return model


def op12_katz_backoff(spark, sf_dir: str) -> DataFrame:
    return fitted(spark.read.parquet(f"{sf_dir}/documents.parquet")).scored()


def _discounts_sql(counts: str) -> str:
    """(r, d): factors from the list ``n`` of counts of counts that table ``counts`` holds."""
    return f"""(WITH k AS (SELECT unnest(range(1, {KEPT + 1})) AS k), e AS (
    SELECT k, unnest(range(1, k + 1)) AS r, n, (k + 1) * n[k + 1] / nullif(n[1], 0) AS common FROM {counts}, k
  ), g AS (SELECT k, r, common < 1 AND n[r] > 0 AS fit, ((r + 1) * n[r + 1] / nullif(r * n[r], 0) - common) / nullif(1 - common, 0) AS d FROM e
  ), best AS (SELECT max(k) AS k FROM (SELECT k FROM g GROUP BY k HAVING bool_and(coalesce(fit AND d > 0 AND d < 1, false))))
  SELECT r, d FROM g SEMI JOIN best USING (k) UNION ALL SELECT 1, 0.5 FROM best WHERE k IS NULL)"""


def _counts_sql(table: str) -> str:
    return f"(SELECT list_transform(range(1, {KEPT + 2}), lambda r: len(list_filter(cs, lambda c: c = r))) AS n FROM (SELECT list(least(c, {KEPT + 2})) AS cs FROM {table}))"


OP12_SQL = rf"""
WITH crc AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t
), docs AS MATERIALIZED (
  SELECT row_number() OVER () AS n, doc_id, coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 7 = 2, false) AS held_out,
         list_concat(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ 	-
]+'), lambda x: x <> ''), ['']) AS ws
  FROM documents, crc
), u AS (SELECT n, held_out, unnest(list_concat([''], ws[:-2])) AS h, unnest(ws) AS w FROM docs
), c1 AS MATERIALIZED (SELECT w, count(*) AS c FROM u WHERE NOT held_out GROUP BY w
), d1 AS MATERIALIZED {_discounts_sql(_counts_sql("c1"))},
t AS MATERIALIZED (SELECT sum(c)::BIGINT AS total, count(*) AS v, coalesce(sum((1 - coalesce(d, 1)) * c), 0) AS rest FROM c1 LEFT JOIN d1 ON r = c
), p1 AS MATERIALIZED (SELECT w, c, coalesce(d, 1) * c / (total + CASE WHEN rest > 0 THEN 0 ELSE 1 END) AS p FROM t, c1 LEFT JOIN d1 ON r = c
), c2 AS MATERIALIZED (SELECT h, w, count(*) AS c FROM u WHERE NOT held_out GROUP BY h, w
), d2 AS MATERIALIZED {_discounts_sql(_counts_sql("c2"))},
a AS MATERIALIZED (
  SELECT h, sum(c2.c) AS n, sum((1 - coalesce(d, 1)) * c2.c) AS rest, sum(p) AS seen FROM c2 JOIN p1 USING (w) LEFT JOIN d2 ON r = c2.c GROUP BY h
), g AS MATERIALIZED (SELECT DISTINCT h, w FROM u
), p2 AS MATERIALIZED (
  SELECT h, w, coalesce(p1.c, 0) AS c, CASE WHEN c2.c > 0 THEN log10(coalesce(d, 1) * c2.c / (a.n + CASE WHEN a.rest > 0 THEN 0 ELSE 1 END))
    ELSE log10(coalesce(p, CASE WHEN t.rest > 0 THEN t.rest / total ELSE 1.0 / (total + 1) END)) + CASE WHEN a.n IS NULL THEN 0 ELSE log10(CASE WHEN a.rest > 0 THEN a.rest / a.n ELSE 1 / (a.n + 1) END / (1 - a.seen)) END END AS score
  FROM t, g LEFT JOIN p1 USING (w) LEFT JOIN a USING (h) LEFT JOIN c2 USING (h, w) LEFT JOIN d2 ON r = c2.c
)
SELECT any_value(doc_id) AS doc_id, any_value(docs.held_out) AS held_out, count(*) AS n_tokens, count(*) FILTER (WHERE c > 0) AS n_known, any_value(total) AS train_tokens,
       sum(log10((c + 1) / (total + v + 1))) AS base_score, sum(score) AS score
FROM t, docs JOIN u USING (n) JOIN p2 USING (h, w) GROUP BY n
"""
