"""Hard-negative mining by dual-tree search over whole-number inner products.

Vectors fall into cells of a tree whose cuts are fitted on at most ``SAMPLE`` rows; each cell (in parts, where it
is large) becomes a block with a tree of its own, whose nodes are balls. Anchors are gathered by cell into groups
with trees of theirs. By Cauchy and Schwarz the inner products of two balls lie in an interval around that of
their centres: a pair of nodes whose interval has nothing that any anchor of the node still wants is dropped
with all that lies below, first for whole blocks and groups, then down both trees; pairs of leaves are scored
exactly. First every anchor's positives are searched, from a bound that its own block gives; then the
negatives in the intervals that the positives set. Nothing is approximate: all rows are candidates.

Edge cases: rows with a null label or vector, or with a null or non-finite component, take no part. An anchor
is a row: rows with one id are candidates of each other, and each brings its own result. Rows without an id
are candidates that lose all ties, and no anchors. Of vectors of different lengths the shorter ends in zeros.
Scores beyond longs end at the range's end. A positive with a negative score has no negatives, one with 0 those with 0. An
empty table gives an empty result. Other columns don't matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import ranges, written
from .vectors import LONGEST, floored, largest, matrix, usable

SCALE, EVERY = 256, 50
POSITIVES, NEGATIVES = 5, 3
SAMPLE = 16384  # rows that the cells' cuts are fitted on
CELL, MOST_CELLS = 1024, 4096  # rows a cell, while there are no more cells than that
BLOCK, GROUP = 1 << 16, 1 << 13  # most candidates of a block, most anchors of a group
LEAF, ANCHOR_LEAF = 256, 64
TOGETHER = 16  # leaves of candidates that are scored in one product

_PART = "kind int, at int, keys array<long>, ids array<long>, labels array<long>, width int, x binary, ends array<int>, seeds array<long>, centre array<double>, radius double, least long, most long"
_NAMES = [c.split()[0] for c in _PART.split(", ")]


def _split(x: np.ndarray, leaf: int) -> tuple[np.ndarray, list[int]]:
    """An order of the rows in which leaves lie together, and where each ends: halves by the widest component."""
    todo, order, ends = [np.arange(len(x))], [], []
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            order.append(rows)
            ends.append(len(rows) + (ends[-1] if ends else 0))
            continue
        axis = x[rows].astype(np.float64).var(0).argmax()
        half = np.argpartition(x[rows, axis], len(rows) // 2)
        todo += [rows[half[len(rows) // 2 :]], rows[half[: len(rows) // 2]]]
    return np.concatenate(order), ends


def _cuts(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Component and value that part each node of a complete tree, in order of levels."""
    axis, value = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1, np.int64)
    rows = {0: sample}
    for node in range(len(axis)):
        own = rows.pop(node)
        if len(own):
            axis[node] = own.astype(np.float64).var(0).argmax()
            value[node] = np.sort(own[:, axis[node]])[(len(own) - 1) // 2]
        right = own[:, axis[node]] > value[node]
        rows[2 * node + 1], rows[2 * node + 2] = own[~right], own[right]
    return axis, value


def _balls(x: np.ndarray, ends) -> tuple[np.ndarray, np.ndarray]:
    edges = [0, *ends]
    centre = np.array([x[a:b].mean(0) for a, b in zip(edges, edges[1:])])
    return centre, np.array([np.sqrt(((x[a:b] - c) ** 2).sum(1).max()) for a, b, c in zip(edges, edges[1:], centre)])


def _levels(centre: np.ndarray, radius: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Balls from the leaves up to the root: node k has the nodes 2k and 2k + 1 of the level below."""
    out = [(centre, radius)]
    while len(centre) > 1:
        pair = np.minimum(np.arange(0, len(centre) + len(centre) % 2).reshape(-1, 2), len(centre) - 1)
        up = centre[pair].mean(1)
        radius = (np.sqrt(((centre[pair] - up[:, None]) ** 2).sum(2)) + radius[pair]).max(1)
        centre = up
        out.append((centre, radius))
    return out


def _interval(a, i, b, j) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products between ball i of level ``a`` and ball j of level ``b``."""
    (ca, ra), (cb, rb) = a, b
    ca, ra, cb, rb = ca[i], ra[i], cb[j], rb[j]
    na, nb = np.sqrt((ca**2).sum(1)), np.sqrt((cb**2).sum(1))
    middle, wide = (ca * cb).sum(1), na * rb + nb * ra + ra * rb
    wide += 1 + 1e-9 * (na + ra) * (nb + rb)  # rounding
    return middle - wide, middle + wide


def _up(values: np.ndarray, ends, pick) -> list[np.ndarray]:
    """``pick`` (np.minimum or np.maximum) of the rows' values by node, level by level."""
    out = [pick.reduceat(values, [0, *ends[:-1]])]
    while len(out[-1]) > 1:
        v = out[-1]
        out.append(pick.reduceat(v, np.arange(0, len(v), 2)))
    return out


def _leaf_pairs(a, b, least, most):
    """Pairs of leaves that may hold wanted products and their upper bounds, by descent of both trees."""
    la, lb = len(a) - 1, len(b) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        low, high = _interval(a[la], i, b[lb], j)
        wanted = (high >= least[la][i]) & (low <= most[la][i])
        i, j, high = i[wanted], j[wanted], high[wanted]
        if la == lb == 0 or not len(i):
            return i, j, high
        if lb >= la:
            lb -= 1
            i, j = np.repeat(i, 2), np.column_stack((2 * j, 2 * j + 1)).ravel()
            there = j < len(b[lb][0])
        else:
            la -= 1
            i, j = np.column_stack((2 * i, 2 * i + 1)).ravel(), np.repeat(j, 2)
            there = i < len(a[la][0])
        i, j = i[there], j[there]


def _products(a: np.ndarray, b: np.ndarray):
    """A function of rows of ``a`` and ``b``: their exact inner products, in the fastest type that holds all partial sums."""
    size = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, size - x.shape[1]))) for x in (a, b))
    norm = np.prod([np.sqrt((x.astype(np.float64) ** 2).sum(1)).max(initial=0) for x in (a, b)])
    kind = np.float32 if norm < 1 << 23 else np.float64 if norm < 1 << 52 else object
    a, b = a.astype(kind), b.astype(kind)
    if kind is object:
        return lambda i, j: np.array([[min(max(v, -LONGEST), LONGEST) for v in r] for r in a[i].dot(b[j].T)], np.int64).reshape(len(i), len(j))
    return lambda i, j: (a[i] @ b[j].T).astype(np.int64)


class _Best:
    """The best ``k`` (score, id) of each slot; no id is the largest."""

    def __init__(self, slots: int, k: int):
        self.k, self.floor = k, np.full(slots, -LONGEST - 1)
        self.slot = self.score = self.id = np.zeros(0, np.int64)
        self.none = np.zeros(0, bool)

    def add(self, slot, score, ids, none):
        slot, score, ids, none = (np.concatenate(p) for p in ((self.slot, slot), (self.score, score), (self.id, ids), (self.none, none)))
        order = np.lexsort((ids, none, -score, slot))
        slot = slot[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        order = order[rank < self.k]
        self.slot, self.score, self.id, self.none = slot[rank < self.k], score[order], ids[order], none[order]
        full = rank == self.k - 1
        self.floor[slot[full]] = self.score[rank[rank < self.k] == self.k - 1]


def _one(table: pa.Table) -> dict:
    row = {n: table.column(n).combine_chunks() for n in table.column_names}
    ids = row["ids"].flatten()
    n, width = len(ids), row["width"][0].as_py()
    out = {n: row[n].flatten().to_numpy(zero_copy_only=False) for n in ("keys", "labels", "seeds", "ends")}
    out |= {n: row[n].flatten().to_numpy(zero_copy_only=False).reshape(-1, POSITIVES) for n in ("low", "high") if n in row}
    x = np.frombuffer(row["x"][0].as_buffer(), f"<i{width}")
    return out | {"at": row["at"][0].as_py(), "ids": ids.fill_null(0).to_numpy(), "none": ids.is_null().to_numpy(zero_copy_only=False), "x": x.reshape(n, -1).astype(np.int64)}


def _row(kind: int, at: int, keys, ids, none, labels, x, seeds, leaf: int | None, least: int, most: int) -> tuple:
    """A block or group as a row: in the order of its tree's leaves, components as narrow as they go."""
    order, ends = _split(x, leaf) if leaf else (np.arange(len(x)), [len(x)])
    x = x[order]
    width = next(w for w in (2, 4, 8) if w == 8 or largest(x) < 1 << (8 * w - 1))
    whole = _levels(*_balls(x.astype(np.float64), ends))[-1] if leaf else (np.zeros((1, 0)), np.zeros(1))
    named = [None if n else int(i) for i, n in zip(ids[order], none[order])]
    seeds = seeds[order].tolist() if seeds is not None else []
    return kind, at, keys[order].tolist(), named, labels[order].tolist(), width, x.astype(f"<i{width}").tobytes(), ends, seeds, whole[0][0].tolist(), float(whole[1][0]), least, most


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


_LONGS, _INTS = pa.list_(pa.int64()), pa.list_(pa.int32())
_ARROW = pa.schema(list(zip(_NAMES, [pa.int32(), pa.int32(), _LONGS, _LONGS, _LONGS, pa.int32(), pa.binary(), _INTS, _LONGS, pa.list_(pa.float64()), pa.float64(), pa.int64(), pa.int64()])))


def _build(groups: np.ndarray, parts: np.ndarray, every: int):
    """A block's row, and a row for each group with the anchors that lie in the block, with what their positives score at least."""

    def build(table: pa.Table) -> pa.Table:
        at = table.column("block")[0].as_py()
        ids = table.column("id").combine_chunks()
        none, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
        labels, x = table.column("label").to_numpy(), matrix(table.column("q"))
        cell = table.column("cell").to_numpy()
        keys = (np.int64(at) << 32) + np.arange(len(ids))
        rows = [_row(0, at, keys, ids, none, labels, x, None, LEAF, 0, 0)]
        mine = np.flatnonzero(~none & (ids % every == 0))
        if len(mine):
            score, seeds, everyone = _products(x, x), np.full(len(mine), -LONGEST - 1), np.arange(len(x))
            for a in range(0, len(mine), 64):
                s = score(mine[a : a + 64], everyone)
                s[labels[mine[a : a + 64], None] != labels[None]] = -LONGEST - 1
                if s.shape[1] > POSITIVES:
                    seeds[a : a + 64] = np.partition(s, s.shape[1] - POSITIVES - 1, 1)[:, -POSITIVES - 1]
            group = groups[cell[mine]] + keys[mine] % parts[cell[mine]]
            for g in np.unique(group).tolist():
                own, seed = mine[group == g], seeds[group == g]
                rows.append(_row(1, g, keys[own], ids[own], none[own], labels[own], x[own], seed, None, 0, 0))
        return _table(rows, _ARROW)

    return build


def _gather(table: pa.Table) -> pa.Table:
    """The pieces of a group as one row with a tree of its anchors."""
    pieces = [_one(table.slice(k, 1)) for k in range(table.num_rows)]
    size = max(p["x"].shape[1] for p in pieces)
    x = np.concatenate([np.pad(p["x"], ((0, 0), (0, size - p["x"].shape[1]))) for p in pieces])
    keys, ids, none, labels, seeds = (np.concatenate([p[n] for p in pieces]) for n in ("keys", "ids", "none", "labels", "seeds"))
    return _table([_row(1, pieces[0]["at"], keys, ids, none, labels, x, seeds, ANCHOR_LEAF, int(seeds.min()), LONGEST)], _ARROW)


def _trees(a: dict, b: dict):
    out = []
    for t in (a, b):
        x = np.pad(t["x"], ((0, 0), (0, max(a["x"].shape[1], b["x"].shape[1]) - t["x"].shape[1]))).astype(np.float64)
        out.append(_levels(*_balls(x, t["ends"])))
    return out


def _visit(a: dict, b: dict, least: np.ndarray, most: np.ndarray, k: int, hits) -> _Best:
    """Scores the leaf pairs that the trees leave, best bounds first; ``hits(rows, products, others, floor)`` gives what counts."""
    best = _Best(least.size, k)
    low, high = least.reshape(len(a["x"]), -1), most.reshape(len(a["x"]), -1)
    i, j, bound = _leaf_pairs(*_trees(a, b), _up(low.min(1), a["ends"], np.minimum), _up(high.max(1), a["ends"], np.maximum))
    score = _products(a["x"], b["x"])
    a_edges, b_edges = np.array([0, *a["ends"]]), np.array([0, *b["ends"]])
    for leaf in np.unique(i).tolist():
        rows = np.arange(a_edges[leaf], a_edges[leaf + 1])
        own = np.flatnonzero(i == leaf)
        own = own[np.argsort(-bound[own], kind="stable")]
        for at in range(0, len(own), TOGETHER):
            floor = np.maximum(least, best.floor).reshape(low.shape)[rows]
            near = own[at : at + TOGETHER]
            near = near[bound[near] >= floor.min()]
            if not len(near):
                break
            others = ranges(b_edges[j[near]], b_edges[j[near] + 1] - b_edges[j[near]])
            s = score(rows, others)
            for slot, r, c in hits(rows, s, others, floor):
                best.add(slot, s[r, c], b["ids"][others[c]], b["none"][others[c]])
    return best


_FOUND = "key long, at int, anchor long, own long, k int, score long, id long"
_FOUND_ARROW = pa.schema([("key", pa.int64()), ("at", pa.int32()), ("anchor", pa.int64()), ("own", pa.int64()), ("k", pa.int32()), ("score", pa.int64()), ("id", pa.int64())])


def _found(a: dict, best: _Best, of: int, own: np.ndarray) -> pa.Table:
    row, k = best.slot // of, best.slot % of
    at = np.full(len(row), a["at"], np.int32)
    return pa.Table.from_arrays(
        [pa.array(c) for c in (a["keys"][row], at, a["ids"][row], own[row], k.astype(np.int32), best.score)] + [pa.array(best.id, mask=best.none)], schema=_FOUND_ARROW
    )


def _positives(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return _FOUND_ARROW.empty_table()
    a, b = _one(left), _one(right)

    def hits(rows, s, others, floor):
        r, c = np.nonzero((s >= floor) & (a["labels"][rows, None] == b["labels"][others][None]))
        yield rows[r], r, c

    own = _products(a["x"], a["x"])
    itself = np.array([own(np.array([r]), np.array([r]))[0, 0] for r in range(len(a["x"]))], np.int64)
    return _found(a, _visit(a, b, a["seeds"], np.full(len(a["x"]), LONGEST), POSITIVES + 1, hits), 1, itself)


def _negatives(left: pa.Table, right: pa.Table) -> pa.Table:
    if not left.num_rows or not right.num_rows:
        return _FOUND_ARROW.empty_table()
    a, b = _one(left), _one(right)
    of = a["low"].shape[1]

    def hits(rows, s, others, floor):
        differs = a["labels"][rows, None] != b["labels"][others][None]
        for k in range(of):
            r, c = np.nonzero((s >= floor[:, k, None]) & (s <= a["high"][rows, k, None]) & differs)
            yield rows[r] * of + k, r, c

    return _found(a, _visit(a, b, a["low"].ravel(), a["high"].ravel(), NEGATIVES, hits), of, np.zeros(len(a["x"]), np.int64))


def _wanted(left: pa.Table, right: pa.Table) -> pa.Table:
    """A group's row with the intervals that the positives of each anchor set; (1, 0) stands for no positive."""
    schema = _ARROW.append(pa.field("low", _LONGS)).append(pa.field("high", _LONGS))
    if not left.num_rows or not right.num_rows:
        return schema.empty_table()
    keys = left.column("keys").combine_chunks().flatten().to_numpy()
    order = np.argsort(keys)
    at = order[np.searchsorted(keys, right.column("key").to_numpy(), sorter=order)]
    k, p = right.column("k").to_numpy(), right.column("positive_score").to_numpy()
    low, high = np.ones((len(keys), POSITIVES), np.int64), np.zeros((len(keys), POSITIVES), np.int64)
    low[at, k], high[at, k] = -(-p // 2), 19 * (p // 20) + 19 * (p % 20) // 20
    some = low <= high
    if not some.any():
        return schema.empty_table()
    out = left.slice(0, 1)
    for name, value in (("least", int(low[some].min())), ("most", int(high[some].max()))):
        out = out.set_column(out.column_names.index(name), name, pa.array([value], pa.int64()))
    return out.append_column("low", pa.array([low.ravel()], _LONGS)).append_column("high", pa.array([high.ravel()], _LONGS)).cast(schema)


def _pairs(groups: DataFrame, blocks: DataFrame, n_blocks: int) -> DataFrame:
    """(group, at) where the interval of whole group and whole block has something that is wanted."""
    ca, cb = F.col("centre"), F.col("c")

    def total(f):
        return F.aggregate(F.zip_with(ca, cb, lambda x, y: f(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0)))), F.lit(0.0), lambda s, x: s + x)

    na, nb = F.sqrt(total(lambda x, y: x * x)), F.sqrt(total(lambda x, y: y * y))
    wide = na * F.col("r") + nb * F.col("radius") + F.col("radius") * F.col("r") + 1 + 1e-9 * (na + F.col("radius")) * (nb + F.col("r"))
    each = groups.select(F.col("at").alias("group"), "centre", "radius", "least", "most", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("at"))
    met = each.join(blocks.select("at", F.col("centre").alias("c"), F.col("radius").alias("r")), "at")
    middle = total(lambda x, y: x * y)
    return met.where((middle + wide >= F.col("least")) & (middle - wide <= F.col("most"))).select("group", "at")


def _meet(groups: DataFrame, blocks: DataFrame, n_blocks: int, visit) -> DataFrame:
    pairs = written(_pairs(groups, blocks, n_blocks), "pairs")
    columns = [c for c in groups.columns if c != "at"]
    left = groups.withColumnRenamed("at", "group").join(pairs, "group").select("group", F.col("at").alias("block"), F.col("group").alias("at"), *columns)
    right = blocks.join(pairs, "at").select("group", F.col("at").alias("block"), *blocks.columns)
    return left.groupBy("group", "block").cogroup(right.groupBy("group", "block")).applyInArrow(visit, _FOUND)


def _planned(rows: DataFrame, every: int) -> tuple[DataFrame, np.ndarray, np.ndarray, int]:
    """Rows with cell and block, each cell's first group and number of groups, and the number of blocks."""
    n = rows.count()
    depth = int(np.clip(np.ceil(np.log2(max(n, 1) / CELL)), 0, np.log2(MOST_CELLS)))
    sample = rows.orderBy(F.xxhash64("id", "q")).limit(SAMPLE).select("q").toArrow()
    sample = matrix(sample.column("q"))
    axis, value = _cuts(sample, depth)
    size = sample.shape[1]

    def place(batches):
        for batch in batches:
            x = matrix(batch.column(batch.schema.get_field_index("q")))
            x = np.pad(x, ((0, 0), (0, max(0, size - x.shape[1]))))
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), axis[node]] > value[node])
            yield batch.append_column("cell", pa.array((node - len(axis)).astype(np.int32)))

    placed = rows.mapInArrow(place, "id long, label long, q array<long>, row long, cell int")
    counts = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("anchors")).collect()  # MOST_CELLS rows at most
    first, parts = np.zeros(1 << depth, np.int64), np.ones(1 << depth, np.int64)
    groups, g_parts = np.zeros(1 << depth, np.int64), np.ones(1 << depth, np.int64)
    n_blocks = group = held = 0
    for r in sorted(counts):
        first[r.cell], parts[r.cell] = n_blocks, -(-r.n // BLOCK)
        n_blocks += int(parts[r.cell])
        if r.anchors > GROUP or held + r.anchors > GROUP:
            group, held = group + 1, 0
        groups[r.cell], g_parts[r.cell] = group, max(1, -(-r.anchors // GROUP))
        group, held = group + int(g_parts[r.cell]) - 1, held + r.anchors if g_parts[r.cell] == 1 else GROUP
    plan = rows.sparkSession.createDataFrame([(c, int(first[c]), int(parts[c])) for c in range(1 << depth)], "cell int, first int, parts int")
    block = (F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int")
    return placed.join(F.broadcast(plan), "cell").select("id", "label", "q", "cell", block.alias("block")), groups, g_parts, n_blocks


def hard_negatives(table: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = SCALE, every: int = EVERY) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; labels as they are in ``label_col``."""
    given = table.where(usable(vector_col) & F.col(label_col).isNotNull())
    rows = written(given.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), floored(vector_col, scale).alias("q"), F.monotonically_increasing_id().alias("row")), "vectors")
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if rows.where(F.col("id") % every == 0).isEmpty():
        return rows.sparkSession.createDataFrame([], out)
    placed, first, parts, n_blocks = _planned(rows, every)
    pieces = written(placed.groupBy("block").applyInArrow(_build(first, parts, every), _PART), "blocks")
    blocks = pieces.where("kind = 0")
    groups = written(pieces.where("kind = 1").groupBy("at").applyInArrow(_gather, _PART), "groups")
    near = _meet(groups, blocks, n_blocks, _positives)
    w = W.partitionBy("key").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = near.withColumn("n", F.row_number().over(w)).where(F.col("n") <= POSITIVES + 1)
    itself = (F.col("id") == F.col("anchor")) & (F.col("score") == F.col("own"))
    seen = F.coalesce(F.sum(F.coalesce(itself, F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    k = (F.col("n") - F.when(F.col("seen") > 0, 2).otherwise(1)).cast("int")  # the anchor's own row goes
    others = ranked.withColumn("itself", F.coalesce(itself, F.lit(False))).withColumn("seen", seen).where("NOT (itself AND seen = 1)").withColumn("k", k).where(F.col("k") < POSITIVES)
    positives = written(others.select("key", "at", F.col("anchor").alias("anchor_id"), "k", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = groups.groupBy("at").cogroup(positives.groupBy("at")).applyInArrow(_wanted, _PART + ", low array<long>, high array<long>")
    found = _meet(written(wanted, "wanted"), blocks, n_blocks, _negatives)
    w = W.partitionBy("key", "k").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= NEGATIVES).select("key", "k", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return positives.join(top, ["key", "k"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.col("label").cast("long")
    return hard_negatives(rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)))


OP11_SQL = r"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS n, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.n, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.n <> b.n WHERE a.vec_id % 50 = 0
), p AS (
  SELECT n, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS k FROM s WHERE same QUALIFY k <= 5
)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.n, p.k ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON s.n = p.n AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
QUALIFY rank <= 3
"""
