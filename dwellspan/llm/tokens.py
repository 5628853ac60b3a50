"""Token ids of whole texts by the tokenizers library, for the byte-level BPE vocabularies.

That library's pre-tokenizer always breaks before a space that a visible character follows, and between
a Latin letter and ASCII punctuation, so a text is the concatenation of chunks cut there, and equal
chunks have equal ids. Each distinct chunk of a
slice is encoded once by the library and kept in a bounded table of the Python worker. Chunks are found by a
hash and then compared byte by byte; rows with a chunk whose hash is another one's are encoded whole."""

from __future__ import annotations

import functools
import os

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

from .shared import mixed, ranges, span_hashes, text_bytes

VOCABULARY = "byte_bpe_50k.json"
TABLE_CHUNKS = 500_000  # chunks a worker remembers before it starts anew

#: A visible character for sure, judged by its first byte: printable ASCII, or a lead byte under which no white space is encoded.
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
_VISIBLE[0xC3:0xF5] = True
_VISIBLE[[0xE1, 0xE2, 0xE3]] = False
_LETTER, _PUNCTUATION = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_PUNCTUATION[0x21:0x7F] = True
_PUNCTUATION[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False

NEAR = 64  # bytes up to which chunks are hashed and compared by words of eight
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # a word's first k bytes
_ODD = np.uint64(0x9FB21C651E98DF25)


class ChunkEncoder:
    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self._keys = np.zeros(0, np.uint64)
        self._at, self._n, self._ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
        self._from, self._size, self._bytes = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(8, np.uint8)  # eight zeros end the bytes

    def _encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        encode = getattr(self._tokenizer, "encode_batch_fast", self._tokenizer.encode_batch)
        got = [e.ids for e in encode(texts, add_special_tokens=False)]
        n = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for ids in got for i in ids), np.uint32, int(n.sum())), n

    def _learn(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        if len(self._keys) + len(keys) > TABLE_CHUNKS and len(self._keys):
            self._clear()
        raw, size = data[ranges(starts, ends - starts)], ends - starts
        edges, whole = np.concatenate(([0], np.cumsum(size))).tolist(), raw.tobytes()
        flat, n = self._encoded([whole[a:b].decode() for a, b in zip(edges, edges[1:])])
        at, start = len(self._ids) + np.cumsum(n) - n, len(self._bytes) - 8 + np.cumsum(size) - size
        self._ids, self._bytes = np.concatenate((self._ids, flat)), np.concatenate((self._bytes[:-8], raw, np.zeros(8, np.uint8)))
        old = (self._keys, self._at, self._n, self._from, self._size)
        table = [np.concatenate(x) for x in zip(old, (keys, at, n, start, size))]
        order = np.argsort(table[0], kind="stable")
        self._keys, self._at, self._n, self._from, self._size = (x[order] for x in table)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids in one array, and each row's bounds in it. Null has no ids."""
        data, bounds = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        cut = np.zeros(len(data), bool)
        cut[:-1] = (data[:-1] == 0x20) & _VISIBLE[data[1:]]
        cut[1:] |= _LETTER[data[:-1]] & _PUNCTUATION[data[1:]]
        for content in self._special:  # a special token's string is cut out first: such texts stay whole
            for row in np.flatnonzero(pc.fill_null(pc.match_substring(column, content), False).to_numpy(zero_copy_only=False)):
                cut[bounds[row] : bounds[row + 1]] = False
        heads = bounds[:-1][bounds[:-1] < bounds[1:]]
        cut[heads] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        data = np.concatenate((data, np.zeros(8, np.uint8)))
        keys, first, which = np.unique(self._hashes(data, starts, ends), return_index=True, return_inverse=True)

        def missing() -> np.ndarray:
            at = np.searchsorted(self._keys, keys)
            at[at == len(self._keys)] = 0
            return np.flatnonzero(self._keys[at] != keys) if len(self._keys) else np.arange(len(keys))

        while len(new := missing()):  # twice at most: the table may be started anew
            self._learn(keys[new], data, starts[first[new]], ends[first[new]])
        known = np.searchsorted(self._keys, keys)
        slot = known[which]
        n = self._n[slot]
        ids = self._ids[ranges(self._at[slot], n)]
        out = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(starts, bounds)]
        odd = ~_same(data, starts, ends - starts, data, starts[first[which]], (ends - starts)[first[which]])
        odd |= ~_same(data, starts[first], (ends - starts)[first], self._bytes, self._from[known], self._size[known])[which]
        return self._with_whole(column, ids, out, np.unique(np.searchsorted(bounds, starts[odd], "right") - 1)) if odd.any() else (ids, out)

    def _with_whole(self, column: pa.Array, ids: np.ndarray, bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``ids`` with those of ``rows`` encoded anew, as whole texts."""
        flat, n = self._encoded([column[int(r)].as_py() for r in rows])
        parts = [ids[a:b] for a, b in zip(bounds, bounds[1:])]
        for r, part in zip(rows.tolist(), np.split(flat, np.cumsum(n)[:-1])):
            parts[r] = part
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))

    @staticmethod
    def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        words, sizes = _words(data), ends - starts
        out = mixed((words[starts] & _FIRST[np.minimum(sizes, 8)]) + sizes.astype(np.uint64) * _ODD)
        at, done = np.flatnonzero((sizes > 8) & (sizes <= NEAR)), 8
        while len(at):
            out[at] = mixed(out[at] * _ODD + (words[starts[at] + done] & _FIRST[np.minimum(sizes[at] - done, 8)]))
            done += 8
            at = at[sizes[at] > done]
        far = np.flatnonzero(sizes > NEAR)
        out[far] = span_hashes(data, starts[far], ends[far])
        return out


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as one number. ``data`` ends with eight bytes that belong to no range."""
    return np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))


def _same(a: np.ndarray, a_starts, a_sizes, b: np.ndarray, b_starts, b_sizes) -> np.ndarray:
    """Whether each range of ``a`` holds the bytes of its range of ``b``; no range is empty."""
    same, of_a, of_b = a_sizes == b_sizes, _words(a), _words(b)
    at, done = np.arange(len(same)), 0
    while len(at):  # ranges that agree so far
        same[at] &= (of_a[a_starts[at] + done] ^ of_b[b_starts[at] + done]) & _FIRST[np.minimum(a_sizes[at] - done, 8)] == 0
        done += 8
        at = at[same[at] & (a_sizes[at] > done) & (a_sizes[at] <= NEAR)]
    far = np.flatnonzero(same & (a_sizes > NEAR))
    if len(far):
        n = a_sizes[far]
        same[far] = ~np.logical_or.reduceat(a[ranges(a_starts[far], n)] != b[ranges(b_starts[far], n)], np.cumsum(n) - n)
    return same


@functools.cache
def encoder(vocabulary: str = VOCABULARY) -> ChunkEncoder:
    return ChunkEncoder(vocabulary)
