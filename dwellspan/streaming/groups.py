"""Pending identities as a stream: the replay of ``operators.groups`` with a day's state in the state store."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dwellspan.operators.groups import MESSAGE, OUTPUT, Day, Group, Rules, Seen, messages
from dwellspan.operators.vectors import Prototypes

SEEN = "number long, first_us long, last_us long, first_place string, last_place string, person string, source string, had_face boolean, group string"
LOOKS = "number long, person string, members array<string>, vectors array<array<double>>, weights array<long>"


class PendingGroups(StatefulProcessor):
    """One map state for tracks, one for persons' and groups' looks, one for forgotten persons; a batch writes back what changed."""

    def __init__(self, rules: Rules):
        self._rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._tracks = handle.getMapState("tracks", "name string", SEEN)
        self._people = handle.getMapState("people", "name string", LOOKS)
        self._groups = handle.getMapState("groups", "name string", LOOKS)
        self._forgotten = handle.getMapState("forgotten", "name string", "at long")
        self._opened = handle.getValueState("opened", "n long")

    def _day(self, key) -> Day:
        day = Day(*key, self._rules)
        for t in sorted((Seen(k[0], *v) for k, v in self._tracks.iterator()), key=lambda t: t.number):
            day.tracks[t.name] = t
        for kind, into in ((self._people, day.people), (self._groups, day.groups)):
            for (name,), (number, person, members, vectors, weights) in sorted(kind.iterator(), key=lambda x: x[1][0]):
                looks = Prototypes(self._rules.capacity, self._rules.merge, vectors, weights)
                into[name] = looks if into is day.people else Group(name, looks, dict.fromkeys(members), person)
        day.forgotten = {k[0] for k, _ in self._forgotten.iterator()}
        day.opened = self._opened.get()[0] if self._opened.exists() else 0
        return day

    def _rows(self, day: Day) -> tuple[dict, dict, dict]:
        looks = lambda p: ([v.tolist() for v in p.vectors], list(p.weights))
        tracks = {n: tuple(v for k, v in asdict(t).items() if k != "name") for n, t in day.tracks.items()}
        people = {n: (k, None, [], *looks(p)) for k, (n, p) in enumerate(day.people.items())}
        groups = {n: (int(n[len(f"ANON-{day.day.replace('-', '')}"):]), g.person, list(g.members), *looks(g.looks)) for n, g in day.groups.items()}
        return tracks, people, groups

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        day = self._day(key)
        before = self._rows(day)
        frame = pd.concat(list(rows))
        out = [r for m in messages(frame) for r in day.take(m)]
        for state, old, new in zip((self._tracks, self._people, self._groups), before, self._rows(day)):
            for name in old.keys() - new.keys():
                state.removeKey((name,))
            for name, row in new.items():
                if old.get(name) != row:
                    state.updateValue((name,), row)
        for name in day.forgotten:
            self._forgotten.updateValue((name,), (0,))
        self._opened.update((day.opened,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    def close(self) -> None:
        pass


def pending(seen: DataFrame, rules: Rules) -> DataFrame:
    """Streaming twin of ``operators.groups.pending_groups``; set ``presence.ROCKSDB`` in the session first."""
    return seen.select("day", "site", *MESSAGE).groupBy("day", "site").transformWithStateInPandas(PendingGroups(rules), OUTPUT, "append", "none")
