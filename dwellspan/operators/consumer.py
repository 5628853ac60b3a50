"""The durable consumer's rule: events of an outbox in order, each once, with holes, poison and announced gaps on record.

An event that skips numbers waits: the numbers before it are asked for again, up to ``RETRIES`` times, then the hole is
recorded and what waits goes on. A gap that the sender announced isn't waited for. A line that can't be used goes to
the dead letters, and its number counts as seen, so it never stalls what follows. A new outbox starts anew."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import lagged

RETRIES = 3
OUTPUT = "engine string, outbox_id string, kind string, seq long, to_seq long, payload string, detail string"


@dataclass
class Consumer:
    """State of one engine's channel. ``take`` and ``tick`` return rows of ``OUTPUT`` without the engine."""

    outbox_id: str | None = None
    last_seq: int = 0
    announced_to: int = 0
    retries: int = 0
    waiting: dict[int, tuple[str, str | None]] = field(default_factory=dict)

    def take(self, outbox_id: str, kind: str, seq: int | None, to_seq: int | None, payload: str, error: str | None) -> list[tuple]:
        """``kind``: event, or gap (an announcement that nothing up to ``to_seq`` can be sent again)."""
        out = []
        if outbox_id != self.outbox_id:
            if self.outbox_id is not None:
                out += self._give_up() + [(outbox_id, "reset", self.last_seq, None, None, self.outbox_id)]
            self.outbox_id, self.last_seq, self.announced_to, self.retries, self.waiting = outbox_id, 0, 0, 0, {}
        if kind == "gap":
            self.announced_to = max(self.announced_to, to_seq or 0)
            return out + self._drain()
        if seq is None:
            return [*out, (outbox_id, "dead", None, None, payload, error or "no seq")]
        if seq <= self.last_seq:
            return [*out, (outbox_id, "duplicate", seq, None, None, None)]
        self.waiting.setdefault(seq, (payload, error))
        return out + self._drain()

    def _accept(self, seq: int) -> tuple:
        payload, error = self.waiting.pop(seq)
        self.last_seq, self.retries = seq, 0
        return self.outbox_id, "dead" if error else "event", seq, None, payload, error

    def _drain(self) -> list[tuple]:
        """Accepts what follows on, starts anywhere in a new outbox, or lies in an announced gap."""
        out = []
        while self.waiting and ((seq := min(self.waiting)) == self.last_seq + 1 or not self.last_seq or seq <= self.announced_to):
            out.append(self._accept(seq))
        return out

    def tick(self) -> list[tuple]:
        """Time is up for the numbers that are missing: they are asked for again, or given up."""
        if not self.waiting:
            return []
        self.retries += 1
        if self.retries <= RETRIES:
            return [(self.outbox_id, "replay", self.last_seq + 1, min(self.waiting) - 1, None, f"attempt {self.retries} of {RETRIES}")]
        return self._skip()

    def _skip(self) -> list[tuple]:
        seq = min(self.waiting)
        hole = (self.outbox_id, "hole", self.last_seq + 1, seq - 1, None, f"{RETRIES} replays")
        return [hole, self._accept(seq), *self._drain()]

    def _give_up(self) -> list[tuple]:
        out = []
        while self.waiting:
            out += self._skip()
        return out


def consumed(lines: DataFrame, announced: DataFrame | None = None, width: int = 1 << 16) -> DataFrame:
    """What a consumer is left with of a whole log, by windows: rows of kind event, dead and hole.

    ``lines``: outbox_id, seq, payload, error; ``announced``: outbox_id, to_seq. Of equal numbers one line counts, of several
    the one without an error. Numbers are looked at in stretches of ``width``, so an outbox isn't one task."""
    best = F.min_by(F.struct("payload", "error"), F.struct(F.col("error").isNotNull(), F.coalesce("payload", F.lit(""))))
    once = lines.where("seq IS NOT NULL").groupBy("outbox_id", "seq").agg(best.alias("row")).select("outbox_id", "seq", "row.*")
    known = once.select("outbox_id", F.when(F.col("error").isNull(), "event").otherwise("dead").alias("kind"), "seq", F.lit(None).cast("long").alias("to_seq"), "payload", "error")
    lost = lines.where("seq IS NULL").select("outbox_id", F.lit("dead").alias("kind"), "seq", F.lit(None).cast("long").alias("to_seq"), "payload", F.coalesce("error", F.lit("no seq")).alias("error"))
    gaps = lagged(once.select("outbox_id", "seq"), ["outbox_id"], ["seq"], {"before": "seq"}, F.floor(F.col("seq") / width)).where("seq > before + 1")
    if announced is not None:
        most = announced.groupBy("outbox_id").agg(F.max("to_seq").alias("told"))
        gaps = gaps.join(most, "outbox_id", "left").where("told IS NULL OR seq > told").drop("told")
    none = F.lit(None).cast("string")
    holes = gaps.select("outbox_id", F.lit("hole").alias("kind"), (F.col("before") + 1).alias("seq"), (F.col("seq") - 1).alias("to_seq"), none.alias("payload"), none.alias("error"))
    return known.unionByName(lost).unionByName(holes)
