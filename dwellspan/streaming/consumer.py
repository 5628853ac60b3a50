"""The durable consumer as a stream: ``operators.consumer`` by engine, with its waiting lines in the state store.

Missing numbers are waited for by processing-time timers: each that runs out emits a replay request, the last one the hole."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dwellspan.operators.consumer import OUTPUT, Consumer

LINE = ("arrival", "outbox_id", "kind", "seq", "to_seq", "payload", "error")
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]


class DurableConsumer(StatefulProcessor):
    def __init__(self, wait_ms: int):
        self._wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._facts = handle.getValueState("facts", "outbox_id string, last_seq long, announced_to long, retries long")
        self._waiting = handle.getMapState("waiting", "seq long", "payload string, error string")

    def _load(self) -> Consumer:
        facts = self._facts.get() if self._facts.exists() else (None, 0, 0, 0)
        return Consumer(*facts, {k[0]: (v[0], v[1]) for k, v in self._waiting.iterator()})

    def _store(self, c: Consumer, before: dict, out: list[tuple], key, now_ms: int, expired: int | None = None) -> Iterator[pd.DataFrame]:
        self._facts.update((c.outbox_id, c.last_seq, c.announced_to, c.retries))
        for seq in before.keys() - c.waiting.keys():
            self._waiting.removeKey((seq,))
        for seq, row in c.waiting.items():
            if before.get(seq) != row:
                self._waiting.updateValue((seq,), row)
        timers = [at for at in self._handle.listTimers() if at != expired]  # the one that ran out goes after this call
        if c.waiting and not timers:
            self._handle.registerTimer(now_ms + self._wait_ms)
        for at in [] if c.waiting else timers:
            self._handle.deleteTimer(at)
        yield pd.DataFrame([(key[0], *r) for r in out], columns=COLUMNS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        c = self._load()
        before, out = dict(c.waiting), []
        for row in pd.concat(list(rows)).sort_values("arrival", kind="stable")[list(LINE)].itertuples(index=False):
            whole = [None if pd.isna(x) else int(x) for x in (row.seq, row.to_seq)]
            out += c.take(row.outbox_id, row.kind, *whole, row.payload, None if pd.isna(row.error) else row.error)
        yield from self._store(c, before, out, key, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        c = self._load()
        before, out = dict(c.waiting), c.tick()
        yield from self._store(c, before, out, key, timerValues.getCurrentProcessingTimeInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def consumed(lines: DataFrame, wait_ms: int = 30_000) -> DataFrame:
    """Streaming ``lines`` (engine and the columns of ``LINE``) to rows of ``OUTPUT``; set ``presence.ROCKSDB`` in the session first."""
    return lines.select("engine", *LINE).groupBy("engine").transformWithStateInPandas(DurableConsumer(wait_ms), OUTPUT, "append", "ProcessingTime")
