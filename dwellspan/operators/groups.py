"""Pending identities: bodies seen without a face gather in anonymous groups until a face tells who they are.

A day of a site is one ordered replay, as each decision rests on all before it. A new track's vector goes to the person
whose gallery it fits best, else to the open group that it fits best, else it opens a group. A face on a track resolves the track's group to
its person and sweeps in the other open groups that fit that person. Two tracks alive at once, or too far apart for
the time between them, are never one person: when spans grow into such a conflict the weaker claim is revoked,
never a face's. Only faces fill galleries; what remains of a day stays anonymous.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwellspan.functions.time import SECOND

from .vectors import Prototypes, unit

OUTPUT = "day string, site string, at_us long, seq long, kind string, track string, identity string, source string, anon_id string, tracks array<string>"
#: How claims are named and which outlast others.
STRENGTH = {"reid": 1, "reid_retro": 2, "face": 3}


@dataclass(frozen=True)
class Rules:
    """Similarity, room and time limits; ``travel`` has seconds between two places, either way."""

    threshold: float = 0.80
    margin: float = 0.05
    travel_s: float = 30.0
    travel: tuple[tuple[str, str, float], ...] = ()
    overlap_s: float = 0.0
    capacity: int = 12
    merge: float = 0.95
    reevaluate: bool = False

    def seconds(self, a: str, b: str) -> float:
        return 0.0 if a == b else next((s for x, y, s in self.travel if {x, y} == {a, b}), self.travel_s)


@dataclass
class Seen:
    """A track: where and when it was seen first and last, and what claims it."""

    name: str
    number: int
    first_us: int
    last_us: int
    first_place: str
    last_place: str
    person: str | None = None
    source: str | None = None
    had_face: bool = False
    group: str | None = None

    def at(self, us: int, place: str | None) -> None:
        if us < self.first_us:
            self.first_us, self.first_place = us, place or self.first_place
        if us >= self.last_us:
            self.last_us, self.last_place = us, place or self.last_place


@dataclass
class Group:
    name: str
    looks: Prototypes
    members: dict[str, None] = field(default_factory=dict)
    person: str | None = None

    @property
    def open(self) -> bool:
        return self.person is None and bool(self.members)


class Day:
    """All state of a day and site; ``take`` replays one message and gives the rows that it causes."""

    def __init__(self, day: str, site: str, rules: Rules):
        self.day, self.site, self.rules = day, site, rules
        self.tracks: dict[str, Seen] = {}
        self.people: dict[str, Prototypes] = {}
        self.groups: dict[str, Group] = {}
        self.forgotten: set[str] = set()
        self.opened = 0

    def take(self, m: dict) -> list[tuple]:
        """``m``: at_us, seq, kind (seen, closed or forget), track, place, embedding, person."""
        self._now, self._out = (m["at_us"], m["seq"]), []
        if m["kind"] == "forget":
            self.forgotten.add(m["person"])
            self.people.pop(m["person"], None)
            for t in [t for t in self.tracks.values() if t.person == m["person"] and not t.had_face]:
                self._revoke(t)
        elif m["kind"] == "closed":
            if t := self.tracks.get(m["track"]):
                t.at(m["at_us"], None)
        else:
            self._seen(m)
        return self._out

    def _say(self, kind: str, track: str | None, identity: str | None, source: str | None, group: str | None, tracks: Iterable[str] = ()) -> None:
        self._out.append((self.day, self.site, *self._now, kind, track, identity, source, group, list(tracks)))

    def _seen(self, m: dict) -> None:
        t = self.tracks.get(m["track"])
        if t is None:
            t = self.tracks[m["track"]] = Seen(m["track"], len(self.tracks), m["at_us"], m["at_us"], m["place"], m["place"])
        t.at(m["at_us"], m["place"])
        v = None if m["embedding"] is None else unit(m["embedding"])
        if m["person"] is not None:
            self._face(t, m["person"], v)
        elif t.person is None and t.group is None:
            if v is not None:
                self._place(t, v)
        else:
            g = self.groups.get(t.group) if t.group else None
            if v is not None and g is not None and g.person is None:
                g.looks.add(v)
                if self.rules.reevaluate:
                    self._again(g)
            self._enforce(t)
        source = "tracking" if t.source == "face" and m["person"] is None else t.source
        self._say("assigned", t.name, t.person or t.group, source if t.person or t.group else None, t.group)

    def _face(self, t: Seen, person: str, v: np.ndarray | None) -> None:
        if v is not None and person not in self.forgotten:
            self.people.setdefault(person, Prototypes(self.rules.capacity, self.rules.merge)).add(v)
        g = self.groups.get(t.group) if t.group else None
        if g is not None and g.person is None:
            self._resolve(g, person, "face_confirmed", t.name)
        elif g is not None and g.person != person:  # the group went to another person: the face wins
            g.members.pop(t.name, None)
            t.group = None
        t.person, t.source, t.had_face = person, "face", True
        self._enforce(t)
        own = self.people.get(person)
        for g in [g for g in self.groups.values() if own is not None and g.open]:
            if own.nearest(g.looks.matrix()) >= self.rules.threshold and self._best(self.people, g.looks.matrix()) == person and self._fit(person, g.members):
                self._resolve(g, person, "group_merged", None)

    def _place(self, t: Seen, v: np.ndarray) -> None:
        """A first vector: to a person, else to an open group, else to a new one."""
        person = self._best(self.people, v[None])
        if person is not None and self._fit(person, [t.name]):
            t.person, t.source = person, "reid"
            return
        name = self._best({g.name: g.looks for g in self.groups.values() if g.open}, v[None])
        if name is None or not all(self._apart(self.tracks[o], t) for o in self.groups[name].members):
            self.opened += 1
            name = f"ANON-{self.day.replace('-', '')}{self.opened:04d}"
            self.groups[name] = Group(name, Prototypes(self.rules.capacity, self.rules.merge))
        self.groups[name].members[t.name] = None
        self.groups[name].looks.add(v)
        t.group, t.source = name, "reid"

    def _again(self, g: Group) -> None:
        """A group with a new look may now fit a person, or another group; the older group takes the younger one in."""
        person = self._best(self.people, g.looks.matrix())
        if person is not None:
            if self._fit(person, g.members):
                self._resolve(g, person, "group_merged", None)
                return
        name = self._best({o.name: o.looks for o in self.groups.values() if o is not g and o.open and len(o.looks)}, g.looks.matrix())
        if name is None or not all(self._apart(self.tracks[a], self.tracks[b]) for a in g.members for b in self.groups[name].members):
            return
        order = list(self.groups)
        keep, gone = sorted((g, self.groups[name]), key=lambda x: order.index(x.name))
        for member in gone.members:
            self.tracks[member].group = keep.name
        self._say("merged", None, keep.name, "group_merged", gone.name, sorted(gone.members))
        keep.members |= gone.members
        for v in gone.looks.matrix():
            keep.looks.add(v)
        del self.groups[gone.name]

    def _resolve(self, g: Group, person: str, why: str, trigger: str | None) -> None:
        g.person = person
        for member in g.members:
            t = self.tracks[member]
            if not t.had_face:
                t.person, t.source = person, "reid_retro"
        self._say("resolved", trigger, person, why, g.name, sorted(g.members))

    def _best(self, owners: dict[str, Prototypes], looks: np.ndarray) -> str | None:
        """The owner that fits best, if well enough and clearly better than the next."""
        scored = sorted(((p.nearest(looks), -k, name) for k, (name, p) in enumerate(owners.items())), reverse=True)
        if not scored or scored[0][0] < self.rules.threshold or (len(scored) > 1 and scored[0][0] - scored[1][0] < self.rules.margin):
            return None
        return scored[0][2]

    def _apart(self, a: Seen, b: Seen) -> bool:
        """Whether two tracks may be one person, by time and place."""
        if a is b:
            return True
        if min(a.last_us, b.last_us) - max(a.first_us, b.first_us) > self.rules.overlap_s * SECOND:
            return False
        early, late = (a, b) if a.first_us <= b.first_us else (b, a)
        return late.first_us - early.last_us >= self.rules.seconds(early.last_place, late.first_place) * SECOND

    def _fit(self, person: str, names: Iterable[str]) -> bool:
        own = [t for t in self.tracks.values() if t.person == person]
        return all(self._apart(o, self.tracks[n]) for n in names for o in own)

    def _enforce(self, t: Seen) -> None:
        """Revokes the weaker of two claims on one identity that time and place rule out; of equals the younger track's."""
        peers = [o for o in self.tracks.values() if o.person == t.person] if t.person is not None else [self.tracks[n] for n in self.groups[t.group].members] if t.group else []
        for o in peers:
            if o is t or self._apart(o, t) or t.source == o.source == "face":
                continue
            weaker = min(t, o, key=lambda x: (STRENGTH.get(x.source or "", 0), -x.number))
            self._revoke(weaker)
            if weaker is t:
                break

    def _revoke(self, t: Seen) -> None:
        self._say("revoked", t.name, t.person or t.group, t.source, t.group)
        if t.group in self.groups:
            self.groups[t.group].members.pop(t.name, None)
        t.group = t.person = t.source = None

    def unresolved(self) -> list[str]:
        return sorted(g.name for g in self.groups.values() if g.open)


MESSAGE = ("at_us", "seq", "kind", "track", "place", "embedding", "person")


def messages(frame) -> Iterator[dict]:
    """A frame's messages in order of time, then of their number."""
    import pandas as pd

    for row in frame.sort_values(["at_us", "seq"], kind="stable")[list(MESSAGE)].itertuples(index=False):
        m = dict(zip(MESSAGE, row))
        yield {k: v if k == "embedding" and v is not None and not np.isscalar(v) else None if v is None or (np.isscalar(v) and pd.isna(v)) else v for k, v in m.items()}


def pending_groups(seen: DataFrame, rules: Rules) -> DataFrame:
    """Rows of ``OUTPUT`` for ``seen``: day, site and the columns of ``MESSAGE``.

    kind 'assigned' follows each sighting; 'resolved', 'merged' (``anon_id`` into ``identity``, with the group's tracks)
    and 'revoked' come before the sighting that caused them."""

    def replay(key, frame):
        import pandas as pd

        day = Day(key[0], key[1], rules)
        return pd.DataFrame([r for m in messages(frame) for r in day.take(m)], columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return seen.select("day", "site", *MESSAGE).groupBy("day", "site").applyInPandas(replay, OUTPUT)


def merges(found: DataFrame) -> DataFrame:
    """group, into: where each group went at last, for ``reports.resolved``."""
    last = found.where("kind IN ('resolved', 'merged')").groupBy(F.col("anon_id").alias("group")).agg(F.max_by("identity", F.struct("at_us", "seq")).alias("into"))
    return last


def unresolved(found: DataFrame) -> DataFrame:
    """day, site, anon_id, tracks: groups that nobody's face resolved and that keep a track."""
    last = found.where("kind = 'assigned'").groupBy("day", "site", "track").agg(F.max_by(F.struct("identity", "anon_id"), F.struct("at_us", "seq")).alias("last"), F.max(F.struct("at_us", "seq")).alias("at"))
    moved = found.where("kind IN ('resolved', 'merged')").select("day", "site", F.col("anon_id").alias("gone")).distinct()
    revoked = found.where("kind = 'revoked'").groupBy("day", "site", "track").agg(F.max(F.struct("at_us", "seq")).alias("revoked"))
    here = last.join(revoked, ["day", "site", "track"], "left").where("last.identity = last.anon_id AND (revoked IS NULL OR revoked <= at)")
    here = here.select("day", "site", "track", F.col("last.anon_id").alias("gone"))
    return here.join(moved, ["day", "site", "gone"], "left_anti").groupBy("day", "site", F.col("gone").alias("anon_id")).agg(F.sort_array(F.collect_list("track")).alias("tracks"))
