"""Open presence as a stateful stream: the transition function of ``operators.state``, keyed by camera."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dwellspan.operators.state import Track, advance, in_order

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTPUT = "camera_id string, track_uuid string, person_id string, start_us long, last_us long, closed_us long, reason string"


class OpenTracks(StatefulProcessor):
    """Keeps each camera's open tracks in map state and emits those that an event closes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._tracks = handle.getMapState("tracks", "track_uuid string", "start_us long, last_us long, person_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_ = {k[0]: Track(k[0], v[0], v[1], v[2]) for k, v in self._tracks.iterator()}
        before, out = set(open_), []
        for event in in_order(pd.concat(list(rows))):
            for track in advance(open_, event).values():
                out.append({"camera_id": key[0], **asdict(track), "closed_us": event["at_us"], "reason": event["type"]})
        for gone in before - set(open_):
            self._tracks.removeKey((gone,))
        for t in open_.values():
            self._tracks.updateValue((t.track_uuid,), (t.start_us, t.last_us, t.person_id))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def closed_tracks(lifecycle: DataFrame) -> DataFrame:
    """Streaming ``lifecycle`` rows to closed tracks; set ``ROCKSDB`` in the session first."""
    return lifecycle.groupBy("camera_id").transformWithStateInPandas(OpenTracks(), OUTPUT, "append", "none")
