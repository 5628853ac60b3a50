"""Interval algebra and sessionisation as window expressions.

Everything partitions on the caller's key first, so the operators of one plan share one exchange."""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .matching import overlap_join
from .ordered import running


def islands(df: DataFrame, key: list[str], order: list, starts_new: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows within ``key``; ``starts_new`` may use window functions over the same order."""
    w = W.partitionBy(*key).orderBy(*order)
    flagged = df.withColumn("__new", F.when(starts_new, 1).otherwise(0))
    return flagged.withColumn(name, F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("__new")


def chained(df: DataFrame, key: list[str], gap_us: int = 0, ties: list[str] = (), start: str = "start_us", end: str = "end_us") -> DataFrame:
    """Adds ``island``: rows whose start is at most ``gap_us`` after the running maximum end belong together."""
    order = [start, *(ties or [end])]
    before = W.partitionBy(*key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    return islands(df, key, order, reach.isNull() | (F.col(start) - reach > gap_us))


def merge(df: DataFrame, key: list[str]) -> DataFrame:
    """Union of the non-empty intervals of each key; touching ones join."""
    rows = chained(df.where("end_us > start_us"), key)
    return rows.groupBy(*key, "island").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("island")


def clip(df: DataFrame, low, high) -> DataFrame:
    """Intersection with a window; empty results go."""
    low, high = (F.lit(x) if isinstance(x, int) else x for x in (low, high))
    return df.withColumn("start_us", F.greatest("start_us", low)).withColumn("end_us", F.least("end_us", high)).where("end_us > start_us")


def complement(merged: DataFrame, key: list[str], low: int, high: int) -> DataFrame:
    """What disjoint intervals leave uncovered of [low, high): leading, inner and trailing parts."""
    w = W.partitionBy(*key).orderBy("start_us")
    rows = clip(merged, low, high).select(*key, "start_us", "end_us", F.lag("end_us", 1, low).over(w).alias("before"), F.lead("start_us").over(w).alias("after"))
    inner = rows.select(*key, F.col("before").alias("start_us"), F.col("start_us").alias("end_us"))
    last = rows.where("after IS NULL").select(*key, F.col("end_us").alias("start_us"), F.lit(high).alias("end_us"))
    return inner.unionByName(last).where("end_us > start_us")


def clipped(wanted: DataFrame, covering: DataFrame, key: list[str]) -> DataFrame:
    """Per wanted interval (with an id in ``key``) the parts c_start, c_end of the key's non-empty covering intervals within it."""
    c = covering.select(*key, F.col("start_us").alias("c_start"), F.col("end_us").alias("c_end"))
    hit = overlap_join(wanted, c.where("c_end > c_start"), key, ("start_us", "end_us"), ("c_start", "c_end")).where("c_start < end_us AND c_end > start_us")
    return hit.select(*key, "start_us", "end_us", F.greatest("c_start", "start_us").alias("c_start"), F.least("c_end", "end_us").alias("c_end"))


def uncovered(wanted: DataFrame, covering: DataFrame, key: list[str]) -> DataFrame:
    """Per wanted interval (with an id in ``key``) what no covering interval of the key overlaps: the
    covering rows are clipped to it, merged, and the gaps between them are returned."""
    span = [*key, "start_us", "end_us"]
    part = clipped(wanted, covering, key).unionByName(wanted.select(*span, F.col("end_us").alias("c_start"), F.col("end_us").alias("c_end")))
    w = W.partitionBy(*span).orderBy("c_start", "c_end").rowsBetween(W.unboundedPreceding, -1)
    gaps = part.withColumn("gap_start", F.coalesce(F.max("c_end").over(w), "start_us")).where("c_start > gap_start")
    return gaps.select(*span, "gap_start", F.col("c_start").alias("gap_end"))


def visits(df: DataFrame, key: list[str], gap_us: int, ident: str = "interval_id", camera: str = "camera_id") -> DataFrame:
    """Visit merge: a visit spans the gaps it bridges, is named after its first segment, and lists its cameras in order of first sight."""
    rows = chained(df, key, gap_us, [ident])
    seen = F.array_sort(F.collect_list(F.struct("start_us", ident, camera)))
    first = rows.groupBy(*key, "island").agg(F.min_by(ident, F.struct("start_us", ident)).alias("first_id"), F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.count(F.lit(1)).alias("segments"), seen.alias("__seen"))
    cameras = F.array_join(F.array_distinct(F.transform("__seen", lambda s: s[camera])), ",")
    return first.select(*key, F.concat(F.lit("visit_"), F.col("first_id").cast("string")).alias("visit_id"), "start_us", "end_us", "segments", cameras.alias("cameras"))


def overlaps(df: DataFrame, key: list[str], ties: list[str]) -> DataFrame:
    """Rows that begin before the previous row of their key ends."""
    w = W.partitionBy(*key).orderBy("start_us", "end_us", *ties)
    return df.withColumn("prev_end_us", F.lag("end_us").over(w)).where("prev_end_us > start_us")


def open_close(df: DataFrame, key: list[str], opens: Column, closes: Column, order: list[str]) -> DataFrame:
    """Ranges from each opening row to the next row that closes; an opening inside an open range adds none."""
    w = W.partitionBy(*key).orderBy(*order)
    marked = df.withColumn("__kind", F.when(opens, 1).when(closes, 0)).where("__kind IS NOT NULL")
    marked = marked.withColumn("__before", F.coalesce(F.lag("__kind").over(w), F.lit(0))).where("__kind <> __before")
    return marked.withColumn("until", F.lead(order[0]).over(w)).where("__kind = 1").drop("__kind", "__before")


class FirstFit:
    """Open chains of one label, by order of opening; rows must come by start. A chain takes a segment that begins at or after its end
    and at most the window later; of several the one opened first does. Two heaps: chains still busy by end, free ones by age."""

    def __init__(self, window_us: int):
        self.window_us, self.opened, self.busy, self.free = window_us, 0, [], []

    def place(self, segment_id, start_us, end_us) -> tuple[list, bool]:
        """The segment's chain ([first segment, start, end, segments]) and whether it is a new one."""
        if start_us is None:
            return [segment_id, start_us, end_us, 1], True
        while self.busy and self.busy[0][0] <= start_us:
            _, age, chain = heappop(self.busy)
            heappush(self.free, (age, chain))
        while self.free and start_us - self.free[0][1][2] > self.window_us:
            heappop(self.free)  # closed for good, as starts only rise
        new = not self.free
        if new:
            self.opened += 1
            age, chain = self.opened, [segment_id, start_us, end_us, 1]
        else:
            age, chain = heappop(self.free)
            chain[2] = chain[2] if end_us is None else max(chain[2], end_us)
            chain[3] += 1
        if chain[2] is not None:
            heappush(self.busy, (chain[2], age, chain))
        return chain, new


def _by_label(df: DataFrame, group: list[str]) -> tuple[DataFrame, list[str]]:
    """Segments with a label, dealt by group and label and in order within each: one pass over a task's rows meets labels one by one."""
    keys = list(dict.fromkeys([*group, "label"]))
    return df.where("label IS NOT NULL").repartition(*keys).sortWithinPartitions(*keys, "start_us", "segment_id"), keys


def _labels(batches, keys: list[str]):
    """Per Arrow batch: its columns as lists, and the label that each row belongs to."""
    for batch in batches:
        columns = dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns)))
        yield columns, list(zip(*(columns[k] for k in keys)))


def stitch_plan(df: DataFrame, group: list[str], window_us: int):
    """Greedy stitching of segments to the first open chain of the same label, in order of start.

    Overlapping segments open parallel chains, so which chain takes a segment depends on earlier choices: a
    sequential rule. Chains hold one label, so a task replays its labels one after the other as their rows come, and keeps the
    chains of one. Without a label a segment is its own chain.
    ``df``: group, segment_id, label, start_us, end_us."""
    rows = df.select(*group, F.col("segment_id").cast("long").alias("segment_id"), "label", "start_us", "end_us")
    schema = rows.select(*group, "segment_id", F.col("segment_id").alias("chain_id")).schema
    dealt, keys = _by_label(rows, group)

    def replay(batches):
        import pyarrow as pa

        label = chains = None
        for c, labels in _labels(batches, keys):
            firsts = []
            for at, segment, start, end in zip(labels, c["segment_id"], c["start_us"], c["end_us"]):
                if at != label:
                    label, chains = at, FirstFit(window_us)
                firsts.append(chains.place(segment, start, end)[0][0])
            yield pa.RecordBatch.from_pydict({**{g: c[g] for g in group}, "segment_id": c["segment_id"], "chain_id": firsts}, schema=out)

    out = to_arrow_schema(schema)
    chains = dealt.mapInArrow(replay, schema)
    return chains.unionByName(rows.where("label IS NULL").select(*group, "segment_id", F.col("segment_id").alias("chain_id")))


def chains(df: DataFrame, group: list[str], windows_us: list[int]) -> DataFrame:
    """The chains of ``stitch_plan`` for several windows in one pass: group, window_us, start_us, end_us, segments."""
    rows = df.select(*group, F.col("segment_id").cast("long").alias("segment_id"), "label", F.col("start_us").cast("long").alias("start_us"), F.col("end_us").cast("long").alias("end_us"))
    columns = ["window_us", "start_us", "end_us", "segments"]
    alone = rows.where("label IS NULL").select(*group, F.explode(F.array(*[F.lit(w).cast("long") for w in windows_us])).alias("window_us"), "start_us", "end_us", F.lit(1).cast("long").alias("segments"))
    dealt, keys = _by_label(rows, group)
    schema, out = alone.schema, to_arrow_schema(alone.schema)

    def replay(batches):
        import pyarrow as pa

        label, fits, kept = None, [], []  # kept: the label's chains with their window

        def batch(rows):
            return pa.RecordBatch.from_pydict(dict(zip([*group, *columns], map(list, zip(*rows)))), schema=out)

        done = []
        for c, labels in _labels(batches, keys):
            places = zip(*(c[g] for g in group))
            for at, place, segment, start, end in zip(labels, places, c["segment_id"], c["start_us"], c["end_us"]):
                if at != label:
                    done += [(*p, w, *chain[1:]) for p, w, chain in kept]
                    label, fits, kept = at, [(w, FirstFit(w)) for w in windows_us], []
                    if len(done) > 1 << 15:
                        yield batch(done)
                        done = []
                for w, fit in fits:
                    chain, new = fit.place(segment, start, end)
                    if new:
                        kept.append((place, w, chain))
        done += [(*p, w, *chain[1:]) for p, w, chain in kept]
        if done:
            yield batch(done)

    return dealt.mapInArrow(replay, schema).unionByName(alone)


#: How far a track may reappear, in frame widths, and how much its size may change.
NEAR, ALIKE = 0.08, 0.6


def sessions(df: DataFrame, key: list[str], gap_us: int, ties: list[str], bucket_us: int = 86_400_000_000) -> DataFrame:
    """``df`` with ``session``: a new one wherever nothing of the key has reached to within ``gap_us``. Runs in stretches of
    time, so a key isn't one task."""
    order, bucket = ["start_us", *ties], F.floor(F.col("start_us") / bucket_us)
    rows = running(df, key, order, F.col("end_us"), bucket, "__reach", F.max, before=True)
    fresh = F.when(F.col("__reach").isNull() | (F.col("start_us") - F.col("__reach") > gap_us), 1).otherwise(0).cast("long")
    return running(rows, key, order, fresh, bucket, "session").drop("__reach")


def stitch_by_place(df: DataFrame, group: list[str], window_us: int) -> DataFrame:
    """Greedy stitching where no one says who is who: a segment goes on the first open chain that ended within the window before it,
    near where it begins and of like size; otherwise it opens a chain. group, segment_id, chain_id (its first segment).

    ``df``: group (camera and epoch: time doesn't run on over a reconnect), segment_id, start_us, end_us, first_box and
    last_box (x1, y1, x2, y2). A chain that nothing has reached for the window is closed, so a camera's quiet moments cut the replay;
    within a session open chains are found by a grid of their last places."""
    schema = ", ".join(f"{c} {t}" for c, t in df.select(*group).dtypes) + ", segment_id long, chain_id long"

    def centre(box):
        return (box[0] + box[2]) / 2, (box[1] + box[3]) / 2, max(1e-9, (box[2] - box[0]) * (box[3] - box[1]))

    def replay(frame):
        import math

        import pandas as pd

        grid, chains, out = {}, [], []  # cell: chains there; chain: [first segment, end, last place]
        for row in frame.sort_values(["start_us", "segment_id"], kind="stable").itertuples(index=False):
            x, y, size = centre(row.first_box)
            cx, cy = math.floor(x / NEAR), math.floor(y / NEAR)
            near = sorted(c for i in (cx - 1, cx, cx + 1) for j in (cy - 1, cy, cy + 1) for c in grid.get((i, j), ()))
            chain = None
            for c in near:
                _, end, (px, py, was), cell = chains[c]
                if row.start_us - end > window_us:
                    grid[cell].discard(c)  # closed for good, as starts only rise
                elif chain is None and row.start_us >= end and math.hypot(px - x, py - y) <= NEAR and min(was, size) / max(was, size) >= ALIKE:
                    chain = c
            place = centre(row.last_box)
            cell = (math.floor(place[0] / NEAR), math.floor(place[1] / NEAR))
            if chain is None:
                chain = len(chains)
                chains.append([row.segment_id, row.end_us, place, cell])
            else:
                first, end, _, was_in = chains[chain]
                grid[was_in].discard(chain)
                chains[chain] = [first, max(end, row.end_us), place, cell]
            grid.setdefault(cell, set()).add(chain)
            out.append((*(getattr(row, g) for g in group), row.segment_id, chains[chain][0]))
        return pd.DataFrame(out, columns=[*group, "segment_id", "chain_id"])

    rows = df.select(*group, F.col("segment_id").cast("long").alias("segment_id"), "start_us", "end_us", "first_box", "last_box")
    return sessions(rows, group, window_us, ["segment_id"]).groupBy(*group, "session").applyInPandas(replay, schema)
