"""Packing and shards against the library's own ids."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.fs
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from dwellspan.llm import packing, sstable
from dwellspan.llm.tokens import ChunkEncoder, encoder

from .conftest import ODD_TEXTS, thue_morse

DATA = "/root/testdata/sf0.01"


TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def library_ids(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab Z9.,'’\n\t\r\x0b\x1c\x85  　é中🙂s"), max_size=40), min_size=1, max_size=4))
def test_chunked_ids_are_the_librarys(texts):
    import pyarrow as pa

    ids, bounds = encoder().encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library_ids(t) for t in texts]


def test_colliding_chunks_have_their_own_ids(spark, corpus, monkeypatch):
    import pyarrow as pa

    texts = [f"x {w} y" for order in (10, 11, 12) for w in thue_morse(order)] + [None, "", "plain words"]
    for hashes in (None, lambda data, starts, ends: data[starts].astype(np.uint64)):  # a hash that knows the first byte alone
        if hashes:
            monkeypatch.setattr(ChunkEncoder, "_hashes", staticmethod(hashes))
        fresh = ChunkEncoder()
        for _ in range(2):
            for part in (texts, texts[::-1], ["pretty plots plan", "x"]):
                ids, bounds = fresh.encode(pa.array(part))
                assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [library_ids(t) for t in part]
    rows = [(k, w) for k, w in enumerate(x for order in (10, 11, 12) for x in thue_morse(order))]
    folder = corpus(rows)
    check_pieces(packing.op6_harmonic_pack(spark, folder).collect(), dict(rows))
    assert {r.doc_id: r.ids_crc32 for r in sstable.op8_token_shards(spark, folder).collect()} == {k: crc([*library_ids(w), 0]) for k, w in rows}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 300), max_size=60))
def test_pack_covers_every_token_once(lengths):
    got = packing.pack(lengths, 64)
    seen = defaultdict(list)
    for content in got:
        assert 0 < sum(n for _, _, n in content) <= 64
        for i, at, n in content:
            seen[i].append((at, n))
    for i, n in enumerate(lengths):
        at = 0
        for a, k in sorted(seen[i]):
            assert a == at
            at += k
        assert at == n
    assert sum(sum(n for _, _, n in c) < 64 for c in got) <= 1


def check_pieces(rows, texts):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for content in by_seq.values():
        at = 0
        for r in sorted(content, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    for doc_id, text in texts.items():
        ids, at = [*library_ids(text), 1], 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), crc(ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    return sum(r.length for r in rows), sum(c[0].padded_to for c in by_seq.values())


def test_op6_whole_table(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    used, room = check_pieces(packing.op6_harmonic_pack(spark, DATA).collect(), {d.doc_id: d.text for d in docs})
    assert used > 0.995 * room


def test_op8_whole_table_and_lookup(spark):
    docs = sorted(spark.read.parquet(f"{DATA}/documents.parquet").collect(), key=lambda d: d.doc_id)
    rows = sorted(sstable.op8_token_shards(spark, DATA).collect(), key=lambda r: r.doc_id)
    start = 0
    for d, r in zip(docs, rows, strict=True):
        ids = [*library_ids(d.text), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), crc(ids))
        start += len(ids)
    manifest = sstable.write_shards(spark.read.parquet(f"{DATA}/documents.parquet"))
    found = {r.doc_id: r.ids for r in sstable.look_up(manifest, [0, 500, 999, 10**9]).collect()}
    assert found == {i: [*library_ids(docs[i].text), 0] for i in (0, 500, 999)}


def test_op8_goes_on_in_further_shards(spark, corpus):
    """Shards are bounded in bytes; numbering and lookup go over all of them, and only those with a key are opened."""
    dice = np.random.default_rng(4)
    rows = [(k, " ".join(f"w{x}" for x in dice.integers(0, 10**6, 400))) for k in range(300)] + [(150, "again")]
    docs = spark.read.parquet(f"{corpus(rows)}/documents.parquet")
    manifest = sstable.write_shards(docs, shard_bytes=10_000)
    files = manifest.collect()
    assert len(files) > 8 and max(r.part for r in files) > 0 and sum(r.n_docs for r in files) == 301
    got = sstable.read_shards(manifest).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(k for k, _ in rows)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    found = sorted((r.doc_id, len(r.ids)) for r in sstable.look_up(manifest, [0, 150, 299, 555]).collect())
    assert found == sorted((k, len(library_ids(t)) + 1) for k, t in rows if k in (0, 150, 299))
    assert sstable.look_up(manifest, []).count() == 0


def test_odd_texts(spark, corpus):
    folder = corpus(ODD_TEXTS)
    got = packing.op6_harmonic_pack(spark, folder).collect()
    check_pieces(got, {})
    assert sum(r.length for r in got) == sum(len(library_ids(t)) + 1 for _, t in ODD_TEXTS)
    shards = sstable.op8_token_shards(spark, folder).orderBy("start").collect()
    assert [r.doc_id for r in shards] == [None, None, 1, 2, 3, 4, 5, 5, 7, 8, 9]
    assert [r.start for r in shards] == np.cumsum([0, *[r.n_tokens for r in shards[:-1]]]).tolist()
    assert shards[2].ids_crc32 == shards[3].ids_crc32 == crc([0])


def test_empty_table(spark, corpus):
    folder = corpus([])
    assert packing.op6_harmonic_pack(spark, folder).count() == 0
    assert sstable.op8_token_shards(spark, folder).count() == 0


def test_shard_file(tmp_path):
    keys = sorted([-5, 0, 3, 3, 1 << 40, *range(1000, 9000, 7)])
    with open(tmp_path / "s", "wb") as out:
        w = sstable.ShardWriter(out)
        for k in keys:
            w.add(sstable.key_of(k), np.arange(abs(k) % 900 + 70_000 * (k == 3), dtype=np.uint32))
        with pytest.raises(ValueError):
            w.add(sstable.key_of(-9), np.zeros(1, np.uint32))
        w.finish()
    store = pyarrow.fs.LocalFileSystem()
    with store.open_input_file(str(tmp_path / "s")) as f:
        r = sstable.ShardReader(f, store.get_file_info(str(tmp_path / "s")).size)
        assert [sstable.id_of(k) for k, _ in r] == keys
        assert r.n_docs == len(keys) and len(r._place) > 2
        assert len(r.get(sstable.key_of(3))) == 2 and len(r.get(sstable.key_of(1007))[0]) == 107
        assert r.get(sstable.key_of(1008)) == [] and r.get(sstable.key_of(None)) == []


@pytest.mark.parametrize("alike", [False, True])
def test_chunks_of_all_lengths_equal_the_library(alike, monkeypatch):
    if alike:  # chunks of one length share a hash: only the comparison tells them apart
        monkeypatch.setattr(ChunkEncoder, "_hashes", staticmethod(lambda data, starts, ends: (ends - starts).astype(np.uint64)))
    words = [w for n in range(1, 140) for w in ("a" * n, "a" * (n - 1) + "b", "b" + "a" * (n - 1))]
    texts = [" ".join(words), *words, None, "", " ".join(reversed(words))]
    coder = ChunkEncoder()
    for _ in range(2):  # from the table the second time
        ids, bounds = coder.encode(pa.array(texts, pa.string()))
        want = [coder._tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
