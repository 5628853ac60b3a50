"""Near-duplicate detection: a Chosen Path set similarity join and its connected components.

Documents are sets of word shingles. Texts of the same words are one class (by a cryptographic digest of all
words), represented by its smallest id, so copies never meet each other again. In each of ``TREES`` independent
trees the representatives branch by minwise tokens: a node selects one or two of the tokens of its depth, by
its own key and 1 / 0.8 on average, and each of its documents goes to the child of each selected token's value. Nodes
of every depth with at most ``LEAF`` documents are compared, only larger ones branch on. Two sets of
similarity 0.8 so have on average one common child of a common node, and a node of a tree in common with
probability 0.84, 0.73, 0.64, 0.58, 0.52, 0.48 at depths 1 to 6: in one of nine trees with over 0.997.

Large nodes that hold nearly all of their parent's documents, or that ``DEPTH`` tokens don't make small, hold
documents that are nearly the same. They are compared with their smallest id and within sub-blocks, and what is
then still apart from that id's component is compared with the whole node, block by block.

Inside a small node all pairs are compared on sketches. First only a maximum spanning forest of the likely pairs is put
forward and confirmed on full sets. Then the documents with likely partners in other components bring
their full sets to the node, where those pairs are compared; only links that join components leave it.
So no group's pairs are written out, and of the pairs that the sketches let pass no link between components is lost.

Classes go by numbers of their own until the end, so ids may repeat: texts with one id are one document, whose
texts' links all count, in any order of rows.

Edge cases: a null or blank text has an empty set, size 0, and is a component of its own, named by its id. Texts with
fewer words than a shingle are one shingle. A row without an id follows its class: its component is the smallest id
there, and it is kept only if there is none. An empty table gives an empty result. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import mixed, ranges, released, span_hashes, text_bytes, text_digests, text_slices, word_spans, written

SHINGLE = 5
PERCENT = 80
TREES, DEPTH = 9, 6
LEAF = 512  # documents of a node that are compared exhaustively
DENSE = 0.7  # share of its parent's documents from which a large node doesn't branch on: tokens don't make it small
SKETCH = 128  # minwise values: 32 bits of each as tokens, 16 in a sketch
TOKENS = SKETCH // DEPTH  # tokens that nodes of one depth select from
LIKELY = 0.67  # share of equal sketch values from which a pair is confirmed on full sets: 0.80 less 3.7 deviations

_RNG = np.random.Generator(np.random.PCG64(77))
_XOR = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64)
_MULTIPLY = _RNG.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ORDER = np.uint64(0x9FB21C651E98DF25)
_BY_LEVEL = _RNG.integers(0, 1 << 63, DEPTH, dtype=np.uint64)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of their words, and each row's bounds in words."""
    data, bounds = text_bytes(column)
    lower = np.arange(256, dtype=np.uint8)
    lower[0x41:0x5B] += 32
    data = lower[data]
    starts, ends, rows = word_spans(data, bounds)
    return data, starts, ends, np.searchsorted(rows, np.arange(len(bounds)))


def _sets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, words: int) -> list[np.ndarray]:
    h = span_hashes(data, starts, ends)
    rolled = h[: max(0, len(h) - words + 1)].copy()
    for t in range(1, words):
        rolled = mixed(rolled * _ORDER + h[t : t + len(rolled)])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            one = h[a : a + 1].copy()
            for t in range(a + 1, b):
                one = mixed(one * _ORDER + h[t : t + 1])
            out.append(mixed(one + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Each row's set of shingles as sorted distinct 64-bit hashes."""
    return _sets(*_words(column), words)


def _word_digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A digest of each row's words in turn, each with one space behind it."""
    size = ends - starts + 1
    stop = np.cumsum(size)
    spaced = np.full(int(size.sum()), 0x20, np.uint8)
    inner = np.ones(len(spaced), bool)
    inner[stop - 1] = False
    spaced[inner] = data[ranges(starts, ends - starts)]
    return text_digests(spaced, np.concatenate(([0], stop))[first])


def minwise(shingles: np.ndarray) -> np.ndarray:
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = (shingles[at : at + 4096, None] ^ _XOR) * _MULTIPLY
        np.minimum(least, part.min(0), out=least)
    return least


def _children(level: int, keys: np.ndarray, mins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of depth ``level`` + 1 below nodes ``keys``, of which each row of ``mins`` has one document:
    their keys, and their rows. What a node selects depends on its key alone."""
    h = mixed(keys ^ _BY_LEVEL[level])
    one = (h % np.uint64(TOKENS)).astype(np.int64)
    two = (one + 1 + ((h >> np.uint64(20)) % np.uint64(TOKENS - 1)).astype(np.int64)) % TOKENS
    branches = np.flatnonzero((h >> np.uint64(62)) == 0)  # a quarter of the nodes select a second token
    rows = np.concatenate((np.arange(len(keys)), branches))
    token = level * TOKENS + np.concatenate((one, two[branches]))
    return mixed(mixed(keys[rows] * _ORDER + token.astype(np.uint64)) + mins[rows, token].astype(np.uint64)), rows


def _roots() -> np.ndarray:
    """Keys of the trees' roots: the first numbers of which no two select the same token and a quarter select two."""
    keys, taken, k = [], set(), 0
    while len(keys) < TREES:
        k += 1
        children = _children(0, np.array([k], np.uint64), np.arange(SKETCH)[None, :])[0]
        h = int(mixed(np.array([k], np.uint64) ^ _BY_LEVEL[0])[0])
        one = h % TOKENS
        selected = {one, (one + 1 + (h >> 20) % (TOKENS - 1)) % TOKENS} if len(children) == 2 else {one}
        if not selected & taken and (len(selected) == 2) == (len(keys) % 4 == 2):
            keys.append(k)
            taken |= selected
    return np.array(keys, np.uint64)


def _signatures(words: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = _roots()
        for part in text_slices(batches, "text"):
            found = _words(part.column(1))
            sets = _sets(*found, words)
            mins = np.stack([minwise(s) for s in sets])
            tokens = (mins >> np.uint64(32)).astype("<u4")
            n = len(sets)
            keys, rows = _children(0, np.tile(roots, n), np.repeat(tokens, len(roots), axis=0))
            order = np.argsort(rows, kind="stable")
            each = np.bincount(rows // len(roots), minlength=n)
            nodes = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(each))), pa.int32()), pa.array(keys[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([d.tobytes() for d in _word_digests(*found)], pa.binary()),
                    nodes,
                    pa.array([t.tobytes() for t in tokens], pa.binary()),
                    pa.array([m.tobytes() for m in (mins >> np.uint64(48)).astype("<u2")], pa.binary()),
                    part.column(2),
                ],
                ["doc_id", "n_shingles", "digest", "nodes", "tokens", "sketch", "mark"],
            )

    return sign


SIGNATURE = "doc_id long, n_shingles long, digest binary, nodes array<long>, tokens binary, sketch binary, mark long"


def _agreeing(sketches: np.ndarray, one: np.ndarray) -> np.ndarray:
    return (sketches == one).sum(1)


def _forest(ids: np.ndarray, labels: np.ndarray, sketches: np.ndarray) -> list[tuple[int, int]]:
    """A maximum spanning forest of the likely pairs of a node (Prim's way)."""
    outside = np.ones(len(ids), bool)
    best, source = np.full(len(ids), -1), np.zeros(len(ids), np.int64)
    edges = []
    for _ in range(len(ids)):
        at = int(np.where(outside, best, -2).argmax())
        if best[at] >= LIKELY * SKETCH:
            edges.append((ids[source[at]], ids[at]))
        outside[at] = False
        same = _agreeing(sketches, sketches[at])
        nearer = outside & (same > best)
        best[nearer], source[nearer] = same[nearer], at
    return edges


def _apart(ids: np.ndarray, labels: np.ndarray, sketches: np.ndarray) -> np.ndarray:
    """The documents of a node that have a likely partner in another component."""
    out = np.zeros(len(ids), bool)
    for i in range(len(ids) - 1):
        likely = np.flatnonzero((labels[i + 1 :] != labels[i]) & (_agreeing(sketches[i + 1 :], sketches[i]) >= LIKELY * SKETCH)) + i + 1
        out[likely] = True
        out[i] |= bool(len(likely))
    return out


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _joining(ids, labels, sketches, sets: list, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that join a node's components: all likely pairs that are still apart are compared on full sets."""
    root = {x: x for x in labels.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for i in range(len(ids) - 1):
        for j in (np.flatnonzero(_agreeing(sketches[i + 1 :], sketches[i]) >= LIKELY * SKETCH) + i + 1).tolist():
            a, b = find(labels[i]), find(labels[j])
            if a != b and _similar(sets[i], sets[j], percent):
                root[a] = b
                edges.append((ids[i], ids[j]))
    return edges


def _groups(table: pa.Table) -> tuple:
    node, block, ids, labels = (table.column(k).to_numpy() for k in range(4))
    edge = np.flatnonzero((node[1:] != node[:-1]) | (block[1:] != block[:-1])) + 1
    return ids, labels, np.frombuffer(b"".join(table.column(4).to_pylist()), "<u2").reshape(len(ids), SKETCH), np.concatenate(([0], edge)), np.concatenate((edge, [len(ids)]))


def _pairs(found: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.concatenate([np.zeros((0, 2), np.int64), *found])
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(1)), pa.array(pairs.max(1))], ["u", "v"])


def _likely_pairs(table: pa.Table) -> pa.RecordBatch:
    ids, labels, sketches, starts, ends = _groups(table)
    two = starts[ends - starts == 2]
    two = two[(sketches[two] == sketches[two + 1]).sum(1) >= LIKELY * SKETCH]
    found = [np.stack((ids[two], ids[two + 1]), 1)]
    for i, j in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
        found.append(np.array(_forest(ids[i:j], labels[i:j], sketches[i:j]), np.int64).reshape(-1, 2))
    return _pairs(found)


def _rows_apart(table: pa.Table) -> pa.RecordBatch:
    ids, labels, sketches, starts, ends = _groups(table)
    keep = np.concatenate([_apart(ids[i:j], labels[i:j], sketches[i:j]) for i, j in zip(starts.tolist(), ends.tolist())])
    return table.filter(pa.array(keep)).combine_chunks().to_batches()[0] if keep.any() else pa.RecordBatch.from_pylist([], table.schema)


def _joining_pairs(percent: int):
    def of(table: pa.Table) -> pa.RecordBatch:
        ids, labels, sketches, starts, ends = _groups(table)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column(5)]
        return _pairs([np.array(_joining(ids[i:j], labels[i:j], sketches[i:j], sets[i:j], percent), np.int64).reshape(-1, 2) for i, j in zip(starts.tolist(), ends.tolist())])

    return of


def _by_node(members: DataFrame, of_nodes, schema: str, *more: str) -> DataFrame:
    """``of_nodes`` over whole (node, block) groups of ``members`` (node, block, doc_id, label, sketch and
    ``more``). A task walks through its nodes in order and holds a batch and one node at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            table = pa.concat_tables([rest, table]) if rest is not None else table
            node, block = table.column(0).to_numpy(), table.column(1).to_numpy()
            last = len(node) - int(((node == node[-1]) & (block == block[-1])).sum())
            if last:
                yield of_nodes(table.slice(0, last))
            rest = table.slice(last)
        if rest is not None:
            yield of_nodes(rest)

    rows = members.select("node", "block", "doc_id", "label", "sketch", *more)
    return rows.repartition("node", "block").sortWithinPartitions("node", "block", "doc_id").mapInArrow(released(run), schema)


def _with_sketch(members: DataFrame, reps: DataFrame) -> DataFrame:
    """``members`` (node, block, doc_id, label) with sketches, which each document brings once for all of its nodes."""
    places = members.groupBy("doc_id").agg(F.collect_list(F.struct("node", "block", "label")).alias("places"))
    return places.join(reps.select("doc_id", "sketch"), "doc_id").select("doc_id", "sketch", F.inline("places"))


PAIR, MEMBER = "u long, v long", "node long, block long, doc_id long, label long, sketch binary"


def _branch(level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = batch.column(1)
                each = np.diff(lists.offsets.to_numpy())
                tokens = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u4").reshape(-1, SKETCH)
                node, size = (lists.flatten().field(k).to_numpy() for k in range(2))
                keys, rows = _children(level, node.view(np.uint64), np.repeat(tokens, each, axis=0))
                ids = np.repeat(batch.column(0).to_numpy(), each)[rows]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids), pa.array(size[rows])], ["node", "doc_id", "above"])

    return run


def nodes(reps: DataFrame) -> DataFrame:
    """node, doc_id, size, dense: the leaves of all trees with at least two documents.

    Level by level the documents of nodes that are too large branch on, one row a document with all of its
    large nodes. Leaves with the same documents (of several trees) count once."""
    keyed = reps.select("doc_id", F.explode("nodes").alias("node"), F.lit(None).cast("long").alias("above"))
    leaves = None
    members = F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("members")
    for depth in range(1, DEPTH + 1):
        sizes = keyed.groupBy("node").agg(F.count(F.lit(1)).alias("size"), members, F.max("above").alias("above")).where("size > 1")
        large = (F.col("size") > LEAF) & F.lit(depth < DEPTH) & (F.col("above").isNull() | (F.col("size") < DENSE * F.col("above")))
        own = F.when(large, F.col("node"))  # each large node stays
        once = sizes.groupBy("size", "members", large.alias("large"), own.alias("own")).agg(F.min("node").alias("node"))
        level = written(keyed.select("node", "doc_id").join(once.select("node", "size", "large"), "node"), f"nodes-{depth}")
        done = level.where("NOT large")
        leaves = done if leaves is None else leaves.unionByName(done)
        if depth == DEPTH or level.where("large").isEmpty():
            break
        above = level.where("large").groupBy("doc_id").agg(F.collect_list(F.struct("node", "size")).alias("nodes"))
        keyed = written(above.join(reps.select("doc_id", "tokens"), "doc_id").mapInArrow(_branch(depth), "node long, doc_id long, above long"), f"level-{depth}")
    return leaves.select("node", "doc_id", "size").withColumn("dense", F.col("size") > LEAF)


class Texts:
    """The text of each class: that of the row with its smallest id. ``classes``: cid, digest, id, none, mark of that row."""

    def __init__(self, rows: DataFrame, classes: DataFrame, repeated: bool, words: int):
        self.rows, self.classes, self.repeated, self.words = rows, classes, repeated, words

    def sets(self, ids: DataFrame) -> DataFrame:
        """doc_id (the class's number), set of the classes in ``ids``. Rows meet their class by id and a hash of the text; the digest decides."""
        words = self.words

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in text_slices(batches, "text"):
                found = _words(part.column(1))
                own = pa.array([d.tobytes() == x.as_buffer().to_pybytes() for d, x in zip(_word_digests(*found), part.column(2))], pa.bool_())
                sets = pa.array([s.tobytes() for s in _sets(*found, words)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sets], ["doc_id", "set"]).filter(own)

        wanted = self.classes.join(ids.select(F.col("doc_id").alias("cid")).distinct(), "cid", "left_semi")
        met = self.rows.join(wanted, ["none", "id", "mark"]).select(F.col("cid").alias("doc_id"), "text", "digest")
        found = met.mapInArrow(released(of), "doc_id long, set binary")
        return written(found.dropDuplicates(["doc_id"]) if self.repeated else found, "sets")


def confirmed(pairs: DataFrame, texts: Texts, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full sets are similar enough."""
    full = texts.sets(pairs.select(F.col("u").alias("doc_id")).unionByName(pairs.select(F.col("v").alias("doc_id"))))
    with_u = pairs.join(full.select(F.col("doc_id").alias("u"), F.col("set").alias("set_u")), "u")
    with_both = with_u.join(full.select(F.col("doc_id").alias("v"), F.col("set").alias("set_v")), "v").select("u", "v", "set_u", "set_v")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_similar(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), percent) for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return with_both.mapInArrow(released(compare), PAIR)


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept."""
    doc = F.col(id_col).cast("long")
    rows = docs.select(doc.alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("mark"))
    signed = written(rows.mapInArrow(released(_signatures(words)), SIGNATURE), "signatures")
    some = signed.where("n_shingles > 0").withColumns({"none": F.col("doc_id").isNull(), "id": F.coalesce("doc_id", F.lit(0))})
    first = some.groupBy("digest").agg(F.min(F.struct("none", "id", "mark")).alias("first")).select("digest", "first.*")
    # Numbers rise with ids: of a dense node the smallest, often the original of its copies, is its centre.
    classes = written(first.orderBy("none", "id", "mark", "digest").withColumn("cid", F.monotonically_increasing_id()), "classes")
    repeated = not some.groupBy("digest", "none", "id", "mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    reps = some.join(classes, ["digest", "none", "id", "mark"])
    reps = reps.dropDuplicates(["cid"]) if repeated else reps
    reps = written(reps.select(F.col("cid").alias("doc_id"), "nodes", "tokens", "sketch"), "representatives")
    leaves = written(nodes(reps), "leaves")
    # Dense nodes: everything with the smallest id; sub-blocks stand in for the node below.
    least = leaves.where("dense").groupBy("node").agg(F.min("doc_id").alias("u"))
    stars = leaves.where("dense").join(least, "node").where("u <> doc_id").select("u", F.col("doc_id").alias("v"))
    block = F.when(F.col("dense"), F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("size") * 2 / LEAF))).otherwise(0).cast("long")
    blocks = leaves.withColumn("block", block)
    forest = _by_node(_with_sketch(blocks.withColumn("label", F.lit(0).cast("long")), reps), _likely_pairs, PAIR)
    named = rows.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "mark", "text")
    texts = Texts(named, classes, repeated, words)
    # Texts with one id are one document.
    several = some.where("NOT none").groupBy("id").agg(F.min("digest").alias("u"), F.max("digest").alias("v")).where("u <> v")
    several = written(several, "several")
    together = some.where("NOT none").join(several.select("id"), "id").select("id", "digest").distinct().join(classes.select("digest", "cid"), "digest")
    together = together.join(together.groupBy("id").agg(F.min("cid").alias("u")), "id").where("u <> cid").select("u", F.col("cid").alias("v"))
    tried = written(forest.unionByName(stars).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    links = confirmed(tried, texts, percent)
    links = written(links if several.isEmpty() else links.unionByName(together), "links")
    label = components(links)
    # Second round: likely pairs across components.
    known = label.select(F.col("id").alias("doc_id"), F.col("component").alias("label"))
    # Dense nodes with the same smallest id, of several trees or branches, hold much the same documents: here they are one, so
    # that a pair meets once and not in each of them.
    merged = leaves.where("dense").join(least, "node").select(F.col("u").alias("node"), "doc_id").distinct()
    merged = merged.join(merged.groupBy("node").agg(F.count(F.lit(1)).alias("size")), "node").select("node", "doc_id", "size", F.lit(True).alias("dense")).withColumn("block", block)
    groups = blocks.where("size > 2 AND NOT dense").unionByName(merged)
    labelled = written(groups.join(known, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")), "labelled")
    # Of a dense node, what is apart from its smallest id's component meets every other sub-block: these visitors, too,
    # come in blocks, so a group holds two blocks whatever the node's size.
    dense = labelled.where("dense")
    lead = dense.groupBy("node").agg(F.min_by("label", "doc_id").alias("lead"))
    rest = dense.join(lead, "node").where("label <> lead").select("node", F.col("block").alias("home"), "doc_id", "label")
    many = rest.groupBy("node").agg(F.ceil(F.count(F.lit(1)) * 2 / LEAF).alias("many"))
    rest = written(rest.join(many, "node").withColumn("visitors", F.pmod(F.xxhash64("doc_id"), F.col("many")) + 1), "rest")
    wide = (F.col("block") * F.lit(1 << 31) + F.col("visitors")).alias("block")  # one number for a sub-block and its visitors, 0: none
    hosts = dense.select("node", "block", "doc_id", "label").join(rest.select("node", "visitors").distinct(), "node").select("node", wide, "doc_id", "label")
    guests = rest.join(dense.select("node", "block").distinct(), "node").where("home <> block").select("node", wide, "doc_id", "label")
    own = labelled.select("node", (F.col("block") * F.lit(1 << 31)).alias("block"), "doc_id", "label")
    members = written(own.unionByName(hosts).unionByName(guests), "members")
    mixed_nodes = members.groupBy("node", "block").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    apart = written(_by_node(_with_sketch(members.join(mixed_nodes, ["node", "block"], "left_semi"), reps), _rows_apart, MEMBER), "apart")
    more = _by_node(apart.join(texts.sets(apart.select("doc_id")), "doc_id"), _joining_pairs(percent), PAIR, "set")
    more = written(more.distinct(), "links")
    if not more.isEmpty():
        label = components(label.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(more))
    each = classes.select("digest", F.when(~F.col("none"), F.col("id")).alias("rep"), "cid").join(label.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    least = each.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_class = written(each.join(least, "component").select("digest", "component_id"), "components")
    ids = some.select("doc_id", "digest", "n_shingles").join(of_class, "digest").select("doc_id", "n_shingles", "component_id")
    alone = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return ids.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i, len(ws) AS n FROM w), g AS (
  SELECT doc_id, i, n, concat_ws(' ', x, lead(x) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o) AS x FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), s AS (SELECT DISTINCT doc_id, x FROM g WHERE i <= n - 3 OR (n < 4 AND i = 1)
), d AS (SELECT doc_id, count(x) AS size FROM documents LEFT JOIN s USING (doc_id) GROUP BY doc_id), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN d x ON x.doc_id = a JOIN d y ON y.doc_id = b WHERE 100 * n >= 80 * (x.size + y.size - n)
), reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT d.doc_id, any_value(size) AS n_shingles, min(other) AS component_id, d.doc_id = min(other) AS kept FROM d JOIN reach USING (doc_id) GROUP BY d.doc_id
"""
