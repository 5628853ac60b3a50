"""Removal of repeated substrings by suffix arrays over shards.

A window is a string of ``LENGTH`` bytes. Each window has an anchor, its smallest hashed ``ANCHOR``-byte
string, so equal windows have equal anchors at equal places; the windows of one anchor are neighbours
and form a context. Anchors are the keys that bring equal windows of a whole corpus together:

1. Tasks gather their documents' anchors and send one entry per distinct anchor, in compact blocks by
   hash range. An anchor counts as shared if two different texts have it.
2. The contexts of shared anchors meet by anchor. Equal contexts are merged in the task first and once
   more where they meet, keeping the smallest doc_id. Anchors of more than ``HOT`` texts send
   single windows instead, each to its own place, so that no anchor fills a task.
3. Where different contexts share an anchor, they are cut to the windows that another one may have, as far as
   bytes beside the anchor agree, and concatenated into shards; induced sorting gives a shard's
   suffix array and permuted common prefixes, and runs of suffixes that share ``LENGTH`` bytes give each
   window the smallest doc_id that has it.
4. A document's removed bytes are the union of its windows with a smaller doc_id.

Texts that are equal as a whole need only their smallest doc_id in steps 2 and 3: all bytes of
the others go if they have a window at all.

Edge cases: a null text is an empty one. Texts shorter than a window keep everything. Repeated rows get
the same result each. A row without id, or whose id also belongs to another text, keeps everything and
affects no other. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SpanHasher, ended_jobs_freed, mixed, ranges, released, released_groups, text_bytes, text_digests, text_slices, written
from .suffixes import permuted_common_prefixes, suffix_array

LENGTH = 50
ANCHOR = 16
SPAN = LENGTH - ANCHOR + 1  # places of an anchor in a window, and windows of a context at most
HOT = 4096  # texts of an anchor from which its windows go separate ways
HOT_KEYS = 10_000  # hot anchors that are named in the plan; more of them are marked by a join
SHARD = 1 << 20  # bytes of a shard, unless one anchor's contexts have more
BLOCK_BYTES = 16 << 20  # text bytes for each range of anchors
CONTEXT_BYTES = 6 << 20  # text bytes for each range of contexts
SLICE = 3 << 19
CHUNK = 1 << 15  # windows whose anchors are found at a time: what that takes stays in a core's cache
STRETCH = 3 << 18  # bytes of contexts that are hashed at a time where they meet
FLUSH = 600_000  # anchors that a task gathers before it deals them out
CONTEXT_FLUSH = 12 << 20  # bytes of contexts that a task gathers before it deals them out

_LOW = np.uint64(0xFFFF)  # anchors are ordered by the other bits of their hashes, then by place


def anchors(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The contexts of concatenated texts: anchor hash, first window's start, number of windows, row."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none.astype(np.uint64), none, none, none
    hashes, place = np.empty(len(data) - ANCHOR + 1, np.uint64), np.empty(len(data) - LENGTH + 1, np.int64)
    for a in range(0, len(place), CHUNK):
        z = min(a + CHUNK, len(place))
        value = SpanHasher(data[a : z + LENGTH - 1]).fixed(ANCHOR)
        hashes[a : z + SPAN - 1] = value
        least, width = value & ~_LOW | np.arange(len(value), dtype=np.uint64), 1
        while width * 2 <= SPAN:
            least, width = np.minimum(least[:-width], least[width:]), width * 2
        if width < SPAN:
            least = np.minimum(least[: width - SPAN], least[SPAN - width :])
        np.add(least & _LOW, a, out=place[a:z], casting="unsafe")
    edge = np.ones(len(place) + 1, bool)
    np.not_equal(place[1:], place[:-1], out=edge[1:-1])
    windowed = np.diff(bounds) >= LENGTH
    edge[bounds[:-1][windowed]] = True
    edge[bounds[1:][windowed] - LENGTH + 1] = True
    cut = np.flatnonzero(edge)
    first, n = cut[:-1], np.diff(cut)
    row = np.searchsorted(bounds, first, "right") - 1
    inside = first + LENGTH <= bounds[row + 1]
    first, n, row = first[inside], n[inside], row[inside]
    return hashes[place[first]], first, n, row


def text_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, digest, copy: whether a smaller doc_id has the same text."""
    rows = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("digest"))
    return written(rows, "digests", collect=True)


ENTRY = np.dtype([("hash", "<u4"), ("texts", "<u4"), ("doc", "<i8"), ("text", "<u8"), ("lo", "<u4"), ("n", "u1")])
_NO_TEXT = np.uint64(0xFFFFFFFFFFFFFFFF)


def _entries(n_blocks: int):
    """Step 1, map side: one entry per distinct anchor of a slice. Those that several texts of the slice
    share are known to be shared; their occurrences stay behind in a block of their own. Texts are told
    apart by a digest of 64 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for part in text_slices(batches, "text", SLICE):
            found = _slice_entries(part, n_blocks)
            if found:
                held.append(found)
                if sum(len(x[0]) for x in held) >= FLUSH:
                    yield _dealt(held, n_blocks)
                    held = []
        if held:
            yield _dealt(held, n_blocks)

    return run


def _slice_entries(part: pa.RecordBatch, n_blocks: int) -> tuple[np.ndarray, ...] | None:
    """Entries to send, their blocks and places in the slice, and the occurrences that stay behind."""
    data, bounds = text_bytes(part.column(1))
    key, first, n, row = anchors(data, bounds)
    if not len(key):
        return None
    doc = part.column(0).to_numpy()
    text = text_digests(data, bounds, 8)[:, 0]
    order = np.lexsort((text[row], key))
    key, first, n, row = key[order], first[order], n[order], row[order]
    head = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    new_text = np.concatenate(([True], (key[1:] != key[:-1]) | (text[row][1:] != text[row][:-1])))
    texts = np.add.reduceat(new_text.astype(np.int64), head)
    sent = np.zeros(len(head), ENTRY)
    sent["hash"], sent["texts"] = key[head] & np.uint64(0xFFFFFFFF), texts
    several = np.repeat(texts > 1, np.diff(np.append(head, len(key))))
    once = texts == 1
    sent["doc"][once], sent["text"][once] = doc[row[head[once]]], text[row[head[once]]]
    sent["lo"][once], sent["n"][once] = (first - bounds[row])[head[once]], n[head[once]]
    block = ((key[head] >> np.uint64(32)) % np.uint64(n_blocks)).astype(np.int64)
    # A text's own repeats of an anchor follow its entry, without texts of their own.
    again = np.flatnonzero(~several & np.concatenate(([False], key[1:] == key[:-1])))
    more = np.zeros(len(again), ENTRY)
    more["hash"], more["doc"], more["text"] = key[again] & np.uint64(0xFFFFFFFF), doc[row[again]], text[row[again]]
    more["lo"], more["n"] = (first - bounds[row])[again], n[again]
    several = np.flatnonzero(several)[np.argsort(order[several])]
    kept = np.zeros(len(several), ENTRY)
    kept["hash"], kept["doc"] = key[several] & np.uint64(0xFFFFFFFF), doc[row[several]]
    kept["text"], kept["lo"], kept["n"] = (key[several] >> np.uint64(32)) % np.uint64(n_blocks), (first - bounds[row])[several], n[several]
    blocks = np.concatenate((block, ((key[again] >> np.uint64(32)) % np.uint64(n_blocks)).astype(np.int64)))
    return np.concatenate((sent, more)), blocks, np.concatenate((order[head], order[again])), kept


def _dealt(held: list, n_blocks: int) -> pa.RecordBatch:
    # By range, and there as the texts have them: neighbours compress well.
    before = np.cumsum([0, *(int(x[2].max()) + 1 for x in held)])
    sent, block, place, kept = (np.concatenate(x) for x in zip(*((a, b, c + at, d) for (a, b, c, d), at in zip(held, before))))
    order = np.argsort(block * before[-1] + place)
    sent, block = sent[order], block[order]
    cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    blobs = [_packed(x) for x in np.split(sent, cuts[1:])]
    names = block[cuts].tolist()
    asks = [True] * len(names)
    if len(kept):  # they carry their ranges, so any group can read them: each task's go where its first document's hash says
        blobs.append(_packed(kept))
        names.append(int(mixed(kept["doc"][:1].view(np.uint64))[0] % np.uint64(n_blocks)))
        asks.append(False)
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(asks), pa.array(blobs, pa.binary())], ["block", "asks", "blob"])


def _packed(entries: np.ndarray) -> bytes:
    """Column by column, compressed."""
    return zstandard.compress(b"".join(np.ascontiguousarray(entries[c]).tobytes() for c in ENTRY.names), 1)


def _unpacked(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    out, at = np.empty(len(raw) // ENTRY.itemsize, ENTRY), 0
    for c in ENTRY.names:
        size = ENTRY[c].itemsize * len(out)
        out[c] = np.frombuffer(raw, ENTRY[c], len(out), at)
        at += size
    return out


SHARED = "doc_id long, lo long, n int, key long, hot boolean"


def _shared(group: pd.DataFrame) -> pd.DataFrame:
    """Step 1, reduce side: the contexts of shared anchors in one hash range. ``key``: range and hash in one."""
    block = int(group["block"].iloc[0])
    asked = np.concatenate([np.zeros(0, ENTRY), *map(_unpacked, group["blob"][group["asks"]])])
    kept = np.concatenate([np.zeros(0, ENTRY), *map(_unpacked, group["blob"][~group["asks"]])])
    order = np.argsort(asked["hash"], kind="stable")
    asked = asked[order]
    head = np.flatnonzero(np.concatenate(([True], asked["hash"][1:] != asked["hash"][:-1]))) if len(asked) else np.zeros(0, np.int64)
    size = np.diff(np.append(head, len(asked)))
    if len(head):
        alone = asked["n"] > 0
        low = np.minimum.reduceat(np.where(alone, asked["text"], _NO_TEXT), head)
        high = np.maximum.reduceat(np.where(alone, asked["text"], np.uint64(0)), head)
        texts = np.add.reduceat(asked["texts"].astype(np.int64), head)
        shared = np.repeat((np.maximum.reduceat(asked["texts"], head) > 1) | (low < high), size)
        hot = np.repeat(texts > HOT, size)
        hot_keys = asked["hash"][head[texts > HOT]]
    else:
        shared = hot = np.zeros(0, bool)
        hot_keys = np.zeros(0, np.uint32)
    pick = shared & (asked["n"] > 0)
    got = asked[pick]
    return pd.DataFrame(
        {
            "doc_id": np.concatenate((got["doc"], kept["doc"], np.full(len(hot_keys), -1))),
            "lo": np.concatenate((got["lo"], kept["lo"], np.zeros(len(hot_keys)))).astype(np.int64),
            "n": np.concatenate((got["n"], kept["n"], np.zeros(len(hot_keys)))).astype(np.int32),
            "key": np.concatenate(((block << 32) + got["hash"].astype(np.int64), (kept["text"].astype(np.int64) << 32) + kept["hash"], (block << 32) + hot_keys.astype(np.int64))),
            "hot": np.concatenate((hot[pick], np.zeros(len(kept), bool), np.ones(len(hot_keys), bool))),
        }
    )


CONTEXTS = "block long, texts binary, ends binary, docs binary, los binary, keys binary, removed boolean"


def _contexts(n_blocks: int, hot_keys: list[int]):
    """Step 2, map side: contexts (or, of hot anchors, windows) by where they meet; a slice's equal ones
    are merged, and what their larger doc_ids lose is settled here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for part in text_slices(batches, "text", SLICE >> 1):
            data, bounds = text_bytes(part.column(1))
            doc = part.column(0).to_numpy()
            list_ = part.column(2).combine_chunks() if isinstance(part.column(2), pa.ChunkedArray) else part.column(2)
            count = np.diff(list_.offsets.to_numpy())
            flat = list_.flatten()
            lo, n, key, hot = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            lo, n = lo.astype(np.int64), n.astype(np.int64)
            row = np.repeat(np.arange(len(doc)), count)
            hot = hot | np.isin(key, hot_keys)
            if hot.any():  # single windows
                times = np.where(hot, n, 1)
                pick = np.repeat(np.arange(len(lo)), times)
                shift = ranges(np.zeros(len(lo), np.int64), times)
                row, key, hot, n = row[pick], key[pick], hot[pick], np.where(hot[pick], 1, n[pick])
                lo = lo[pick] + shift
            start = bounds[row] + lo
            content = SpanHasher(data)(start, start + n + LENGTH - 1)
            key = np.where(hot, content.view(np.int64), key)
            order = np.lexsort((lo, doc[row], content, key))
            row, lo, n, key, start, content = (x[order] for x in (row, lo, n, key, start, content))
            new = _new_content(data, key, content, start, n + LENGTH - 1)
            head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            lost = ~new & (doc[row] > doc[row[head]])
            if lost.any():
                yield _rows([-1], [b""], [n[lost]], [doc[row[lost]]], [lo[lost]], [key[lost]], [True])
            # Repeats within the smallest document follow their context's fate: they are sent too.
            send = new | ~lost
            row, lo, n, key, start = (x[send] for x in (row, lo, n, key, start))
            block = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % n_blocks
            held.append((data[ranges(start, n + LENGTH - 1)], block, n, doc[row], lo, key))
            if sum(len(x[0]) for x in held) >= CONTEXT_FLUSH:
                yield _dealt_contexts(held)
                held = []
        if held:
            yield _dealt_contexts(held)

    return run


def _dealt_contexts(held: list[tuple]) -> pa.RecordBatch:
    data, block, n, doc, lo, key = (np.concatenate(x) for x in zip(*held))
    size = n + LENGTH - 1
    order = np.argsort(block, kind="stable")
    start = (np.cumsum(size) - size)[order]
    block, n, doc, lo, key, size = (x[order] for x in (block, n, doc, lo, key, size))
    cuts = np.append(np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))) if len(block) else [], len(block)).astype(np.int64)
    out = [[], [], [], [], [], [], []]
    for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        text = zstandard.compress(data[ranges(start[a:z], size[a:z])], 1)
        for column, x in zip(out, (block[a], text, n[a:z], doc[a:z], lo[a:z], key[a:z], False)):
            column.append(x)
    return _rows(*out)


def _new_content(data: np.ndarray, key: np.ndarray, content: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which of the contexts, ordered by key and hash, differ from the one before, byte by byte: equal hashes
    only bring candidates together."""
    new = np.ones(len(key), bool)
    at = np.flatnonzero((key[1:] == key[:-1]) & (content[1:] == content[:-1]) & (size[1:] == size[:-1])) + 1
    if len(at):
        words = np.ndarray(len(data) - 7, "<u8", np.ascontiguousarray(data), strides=(1,))  # at any byte
        a, b, n = start[at], start[at - 1], size[at]
        same = words[a + n - 8] == words[b + n - 8]
        for k in range(0, int(n.max()) - 7, 8):
            inside = n >= k + 8
            same &= ~inside | (words[np.where(inside, a + k, 0)] == words[np.where(inside, b + k, 0)])
        new[at] = ~same
    return new


def _hashes(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of contexts that lie one behind the other, in stretches: a hasher takes 24 bytes for each byte, and as many while it is made."""
    cuts = np.append(np.flatnonzero(np.diff(start // STRETCH, prepend=-1)), len(start)).tolist()
    out = np.empty(len(start), np.uint64)
    for a, z in zip(cuts[:-1], cuts[1:]):
        low = start[a]
        out[a:z] = SpanHasher(data[low : start[z - 1] + size[z - 1]])(start[a:z] - low, start[a:z] - low + size[a:z])
    return out


def _rows(blocks, texts, ns, docs, los, keys, removed) -> pa.RecordBatch:
    raw = [pa.array([x.astype(t).tobytes() for x in column], pa.binary()) for column, t in ((ns, "u1"), (docs, "<i8"), (los, "<u4"), (keys, "<i8"))]
    return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(texts, pa.binary()), *raw, pa.array(removed)], ["block", "texts", "ends", "docs", "los", "keys", "removed"])


REMOVED = "doc_id long, los binary, ns binary"


def _settled(group: pd.DataFrame) -> pd.DataFrame:
    """Steps 2 and 3 where contexts meet: the windows of each document that a smaller doc_id has."""
    n, doc, lo, key = (np.frombuffer(b"".join(group[c]), t) for c, t in (("ends", "u1"), ("docs", "<i8"), ("los", "<u4"), ("keys", "<i8")))
    n, lo = n.astype(np.int64), lo.astype(np.int64)
    if group["removed"].iloc[0]:
        return _spans(doc, lo, n)
    data = np.frombuffer(b"".join(map(zstandard.decompress, group["texts"])), np.uint8)
    size = n + LENGTH - 1
    start = np.cumsum(size) - size
    content = _hashes(data, start, size)
    order = np.lexsort((lo, doc, content, key))
    n, doc, lo, key, start, size, content = (x[order] for x in (n, doc, lo, key, start, size, content))
    new_key = np.concatenate(([True], key[1:] != key[:-1]))
    new = _new_content(data, key, content, start, size)
    head = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    lost = doc > doc[head]
    found = [(doc[lost], lo[lost], n[lost])]
    # The smallest document of each context, once each; contexts alone under their key need no shard.
    first = np.flatnonzero(new)
    group_of = np.cumsum(new_key)[first]
    several = np.bincount(group_of)[group_of] > 1
    first, group_of = first[several], group_of[several]
    if len(first):
        met = [_meeting(data, group_of[a:z], start[first[a:z]], n[first[a:z]]) for a, z in _shards(group_of, size[first])]
        skip, count = (np.concatenate(x) for x in zip(*met))
        first, group_of, skip, count = (x[count > 0] for x in (first, group_of, skip, count))
        members = np.flatnonzero(~lost)
        for a, z in _shards(group_of, count + LENGTH - 1):
            part = first[a:z]
            cut, low = _window_owners(data, start[part] + skip[a:z], count[a:z] + LENGTH - 1, count[a:z], doc[part])
            # All rows of these contexts' smallest documents (a document may repeat its context).
            rows = members[np.isin(head[members], part)]
            at = np.searchsorted(part, head[rows])
            times, begins = count[a:z][at], lo[rows] + skip[a:z][at]
            window = ranges(cut[at], times)
            gone = low[window] < np.repeat(doc[rows], times)
            edge = np.concatenate(([0], np.cumsum(times)))
            begin = gone.copy()
            begin[1:] &= ~gone[:-1]
            begin[edge[:-1]] = gone[edge[:-1]]
            end = gone.copy()
            end[:-1] &= ~gone[1:]
            end[edge[1:] - 1] = gone[edge[1:] - 1]
            b, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
            owner = np.searchsorted(edge, b, "right") - 1
            found.append((doc[rows[owner]], begins[owner] + b - edge[owner], e - b))
    return _spans(*(np.concatenate(x) for x in zip(*found)))


def _shards(group_of: np.ndarray, size: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of shards in ordered contexts; those of one anchor stay together."""
    head = np.searchsorted(group_of, group_of)
    shard_of = (np.cumsum(size + 1) - size - 1)[head] // SHARD
    cuts = np.append(np.flatnonzero(np.diff(shard_of, prepend=-1)), len(size)).tolist()
    return list(zip(cuts[:-1], cuts[1:]))


def _meeting(data: np.ndarray, group_of: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows of each context that another one of its anchor may have: how many to skip, how many follow.

    Equal windows have their anchor at equal places, so a window can only recur as far as the bytes on both sides of
    the anchor agree with some other context's. What lies beyond need not be sorted."""
    size = n + LENGTH - 1
    data = data[ranges(start, size)]
    start = np.cumsum(size) - size
    value = SpanHasher(data).fixed(ANCHOR) & ~_LOW
    anchor = start + n - 1  # the first place that all windows of a context cover
    least = value[anchor]
    for k in range(1, SPAN):
        at = np.flatnonzero(n <= SPAN - k)
        at = at[value[start[at] + n[at] - 1 + k] < least[at]]
        anchor[at] = start[at] + n[at] - 1 + k
        least[at] = value[anchor[at]]
    left = _agreeing(data, group_of, anchor - 1, -1, anchor - start)
    right = _agreeing(data, group_of, anchor + ANCHOR, 1, start + size - anchor - ANCHOR)
    return anchor - start - left, np.maximum(0, left + right + ANCHOR - LENGTH + 1)


def _agreeing(data: np.ndarray, group_of: np.ndarray, at: np.ndarray, step: int, room: np.ndarray) -> np.ndarray:
    """How many of a context's ``room`` bytes from ``at`` on agree with another one's of the group at most."""
    side = LENGTH - ANCHOR
    sides = np.zeros((len(at), -(-side // 8) * 8), np.uint8)
    for k in range(side):
        inside = np.flatnonzero(k < room)
        sides[inside, k] = data[at[inside] + step * k]
    order = np.lexsort((*sides.view(">u8").astype(np.uint64).T[::-1], group_of))
    sides, group_of = sides[order], group_of[order]
    differs = sides[1:] != sides[:-1]
    alike = np.where(differs.any(1), differs.argmax(1), side)  # of neighbours in order: no others agree further
    alike[group_of[1:] != group_of[:-1]] = 0
    out = np.empty(len(at), np.int64)
    out[order] = np.maximum(np.append(alike, 0), np.append(0, alike))
    return np.minimum(out, room)


def _window_owners(data: np.ndarray, start: np.ndarray, size: np.ndarray, n: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a shard of contexts: where each one's windows begin in the second array, which holds the
    smallest doc_id of each window."""
    at = np.cumsum(size + 1) - size - 1
    shard = np.zeros(int((size + 1).sum()), np.int64)  # 0 parts the contexts
    inner = ranges(at, size)
    shard[inner] = data[ranges(start, size)].astype(np.int64) + 1
    order = suffix_array(shard, 257)
    _, common = permuted_common_prefixes(shard, order, 2 * (LENGTH + SPAN))
    owner = np.full(len(shard), np.iinfo(np.int64).max)
    window = ranges(at, n)
    owner[window] = np.repeat(doc, n)
    runs = np.flatnonzero(np.concatenate(([True], common[order[1:]] < LENGTH)))
    low = np.minimum.reduceat(owner[order], runs)
    owner[order] = np.repeat(low, np.diff(np.append(runs, len(order))))
    return np.cumsum(n) - n, owner[window]


def _spans(doc: np.ndarray, lo: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    """One row per document: the first windows and numbers of windows of all its spans."""
    order = np.argsort(doc, kind="stable")
    doc = doc[order]
    head = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1)) if len(doc) else np.zeros(0, np.int64)
    edges, los, ns = [*head.tolist(), len(doc)], lo[order].astype("<u4").tobytes(), n[order].astype("u1").tobytes()
    pairs = list(zip(edges, edges[1:]))
    return pd.DataFrame({"doc_id": doc[head], "los": [los[4 * a : 4 * z] for a, z in pairs], "ns": [ns[a:z] for a, z in pairs]})


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: the bytes that stay."""
    for part in text_slices(batches, "text", SLICE):
        data, bounds = text_bytes(part.column(1))
        copy, lists = part.column(2).to_numpy(zero_copy_only=False), part.column(3)
        size = np.diff(bounds)
        of_list = np.repeat(np.arange(len(size)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        los, edges = text_bytes(lists.flatten().field(0))
        lo, n = np.frombuffer(los.tobytes(), "<u4").astype(np.int64), text_bytes(lists.flatten().field(1))[0].astype(np.int64)
        whole = np.flatnonzero(copy & (size >= LENGTH))
        row = np.concatenate((np.repeat(of_list, np.diff(edges) // 4), whole))
        lo, end = np.concatenate((lo, size[whole] * 0)) + bounds[row], np.concatenate((lo + n + LENGTH - 1, size[whole])) + bounds[row]
        order = np.argsort(lo, kind="stable")
        row, lo, end = row[order], lo[order], np.maximum.accumulate(end[order])
        new = np.ones(len(row), bool)  # maximal removed runs; they end with their document
        new[1:] = (lo[1:] > end[:-1]) | (row[1:] != row[:-1])
        row, lo, end = row[new], lo[new], end[np.append(new[1:], True)[: len(new)]]
        step = np.zeros(len(data) + 1, np.int8)
        step[lo] += 1
        step[end] -= 1
        kept = data[np.cumsum(step[:-1], dtype=np.int8) == 0]
        n_removed = np.bincount(row, end - lo, len(size)).astype(np.int64)
        kept_bounds = np.concatenate(([0], np.cumsum(size - n_removed)))
        binary = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(kept_bounds.astype(np.int64)), pa.py_buffer(kept)]).cast(pa.binary())
        columns = [part.column(0), pa.array(size), pa.array(n_removed), pa.array(np.bincount(row, minlength=len(size))), binary]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    digests = text_classes(texts)
    total = digests.agg(F.sum("n_bytes")).first()[0] or 0
    n_blocks, n_places = (max(1, -(-total // size)) for size in (BLOCK_BYTES, CONTEXT_BYTES))
    known, usable = digests.where("doc_id IS NOT NULL"), texts.where("doc_id IS NOT NULL")
    unclear = known.groupBy("doc_id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a <> b").select("doc_id")
    if not unclear.isEmpty():
        known, usable = (x.join(unclear, "doc_id", "left_anti") for x in (known, usable))
    classes = known.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = written(known.join(classes, "digest").where("doc_id > least").select("doc_id", "digest").distinct(), "copies", collect=True)
    blobs = usable.mapInArrow(released(_entries(n_blocks)), "block long, asks boolean, blob binary")
    shared = blobs.groupBy("block").applyInPandas(released_groups(_shared), SHARED)
    # One row per document, and the hot keys in rows of their own: all of one shuffle.
    key_row = F.col("n") == 0
    shared = shared.withColumn("is_key", key_row).withColumn("doc_id", F.when(key_row, F.pmod("key", F.lit(1024))).otherwise(F.col("doc_id")))
    shared = shared.join(copies.select("doc_id", F.lit(False).alias("is_key")).distinct(), ["doc_id", "is_key"], "left_anti")
    spot = F.struct(F.col("lo").cast("int").alias("lo"), "n", "key", "hot")
    grouped = written(shared.groupBy("doc_id", "is_key").agg(F.collect_list(spot).alias("spots")), "spots", collect=True)
    hot = [r.key for r in grouped.where("is_key").select(F.explode("spots").alias("s")).select("s.key").distinct().limit(HOT_KEYS + 1).collect()]
    ended_jobs_freed(docs.sparkSession)  # the shuffles that made the spots, before those of the texts are added
    spots = grouped.where("NOT is_key").select("doc_id", "spots")
    if len(hot) > HOT_KEYS:  # too many to name in the plan: mark them by a join
        keys = grouped.where("is_key").select(F.explode("spots").alias("s")).select(F.col("s.key").alias("hot_key")).distinct()
        each = spots.select("doc_id", F.explode("spots").alias("s")).join(keys, F.col("s.key") == F.col("hot_key"), "left")
        marked = F.struct("s.lo", "s.n", "s.key", (F.col("s.hot") | F.col("hot_key").isNotNull()).alias("hot"))
        spots, hot = each.groupBy("doc_id").agg(F.collect_list(marked).alias("spots")), []
    named = texts.where("doc_id IS NOT NULL")
    with_spots = named.join(spots, "doc_id").select("doc_id", "text", "spots")
    contexts = with_spots.mapInArrow(released(_contexts(n_places, hot)), CONTEXTS)
    place = F.when(F.col("removed"), F.pmod(F.xxhash64("docs"), F.lit(n_places)) + n_places).otherwise(F.col("block"))
    gone = contexts.withColumn("block", place).groupBy("block").applyInPandas(released_groups(_settled), REMOVED)
    gone = gone.groupBy("doc_id").agg(F.collect_list(F.struct("los", "ns")).alias("spans"))
    copied = copies.groupBy("doc_id").agg(F.collect_set("digest").alias("copied"))
    copy = F.coalesce(F.array_contains("copied", F.unhex(F.sha2("text", 256))), F.lit(False)).alias("copy")
    whole = named.join(gone, "doc_id", "left").join(copied, "doc_id", "left").select("doc_id", "text", copy, "spans")
    out = whole.mapInArrow(released(_cut), RESULT)
    nameless = texts.where("doc_id IS NULL").select("doc_id", "text", F.lit(False).alias("copy"), F.lit(None).cast(whole.schema["spans"].dataType).alias("spans"))
    return out.unionByName(nameless.mapInArrow(released(_cut), RESULT))


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
