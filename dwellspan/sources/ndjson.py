"""Track logs and spans as data sources: ``spark.read.format("track_log").load(folder)`` and ``df.write.format("track_log")``.

A line is a JSON object. Files are read in ranges of bytes, so one large file is many tasks; a line belongs to the range that its
first byte lies in. A line that can't be read stops the job with its file and number (which is counted only then). Files are
reached through Arrow's file systems, so a path may name any store that they know. A writer's task writes one file under a
name of its own; when a job is aborted, the files of its finished tasks are removed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

RANGE = 32 << 20

#: The formats' fields. A track is an array by position; its zone came later and may be missing.
TRACK = "track_id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, state STRING, score DOUBLE, zone STRING"
FRAME = f"cam STRING, f BIGINT, pts DOUBLE, e INT, w INT, h INT, tr ARRAY<STRUCT<{TRACK}>>"
SPAN = "cam STRING, stage STRING, f BIGINT, pts DOUBLE, t0 DOUBLE, t1 DOUBLE, ms DOUBLE, track_uuid STRING"


def _number(value, kind):
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise ValueError(f"{value!r} is no number")
    return kind(value)


def _frame(line: dict) -> tuple:
    tracks = []
    for t in line["tr"]:
        if len(t) < 7:
            raise ValueError(f"a track has {len(t)} fields")
        tracks.append((_number(t[0], int), *(_number(x, float) for x in t[1:5]), str(t[5]), _number(t[6], float), str(t[7]) if len(t) > 7 else "interior"))
    return str(line["cam"]), _number(line["f"], int), _number(line["pts"], float), *(_number(line[k], int) for k in "ewh"), tracks


def _frame_line(row) -> dict:
    places = (None, 5, 5, 5, 5, None, 4, None)
    tracks = [[v if p is None else round(v, p) for v, p in zip(t, places)] for t in row.tr or []]
    return {"cam": row.cam, "f": row.f, "pts": round(row.pts, 4), "e": row.e, "w": row.w, "h": row.h, "tr": tracks}


def _span(line: dict) -> tuple:
    return str(line["cam"]), str(line["stage"]), _number(line["f"], int), *(_number(line[k], float) for k in ("pts", "t0", "t1", "ms")), line.get("track_uuid")


def _span_line(row) -> dict:
    """Milliseconds follow from the times."""
    return {"cam": row.cam, "stage": row.stage, "f": row.f, "pts": round(row.pts, 4), "t0": round(row.t0, 6), "t1": round(row.t1, 6), "ms": round((row.t1 - row.t0) * 1000, 4), "track_uuid": row.track_uuid}


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int


class Lines(DataSourceReader):
    def __init__(self, path: str, size: int, decode):
        self._path, self._size, self._decode = path, size, decode

    def partitions(self) -> list[Range]:
        store, path = fs.FileSystem.from_uri(self._path) if "://" in self._path or self._path.startswith("file:") else (fs.LocalFileSystem(), self._path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(f"{self._path} doesn't exist: logs are written by a run, not supplied")
        files = [info] if info.is_file else [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [Range(f.path, a, min(a + self._size, f.size)) for f in sorted(files, key=lambda f: f.path) for a in range(0, f.size, self._size)] or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        store = fs.FileSystem.from_uri(self._path)[0] if "://" in self._path or self._path.startswith("file:") else fs.LocalFileSystem()
        with store.open_input_file(part.path) as f:
            f.seek(max(0, part.start - 1))
            ahead = f.read(1) if part.start else b"\n"
            rest, at = b"", part.start
            skip = ahead != b"\n"  # the line that reaches in belongs to the range before
            while at < part.end or rest:
                cut = rest.find(b"\n")
                if cut < 0:
                    more = f.read(1 << 20)
                    if more:
                        rest += more
                        continue
                    cut = len(rest)
                line, rest = rest[:cut], rest[cut + 1 :]
                first, at = at, at + cut + 1
                if skip:
                    skip = False
                elif first >= part.end:
                    return
                elif line.strip():
                    try:
                        yield self._decode(json.loads(line))
                    except (ValueError, KeyError, TypeError, IndexError) as e:
                        f.seek(0)
                        number = f.read(first).count(b"\n") + 1
                        raise ValueError(f"{part.path}, line {number}: {type(e).__name__}: {e}: {line[:200]!r}") from e
                if not rest and at >= part.end:
                    return


@dataclass
class Written(WriterCommitMessage):
    path: str | None


class LineWriter(DataSourceWriter):
    def __init__(self, path: str, encode):
        self._path, self._encode = path, encode

    def _store(self):
        return fs.FileSystem.from_uri(self._path) if "://" in self._path or self._path.startswith("file:") else (fs.LocalFileSystem(), self._path)

    def write(self, rows) -> Written:
        store, folder = self._store()
        store.create_dir(folder, recursive=True)
        path, out = f"{folder}/part-{uuid.uuid4().hex}.ndjson", None
        for row in rows:
            out = out or store.open_output_stream(path)
            out.write(json.dumps(self._encode(row), separators=(",", ":"), ensure_ascii=False).encode() + b"\n")
        if out:
            out.close()
        return Written(path if out else None)

    def commit(self, messages) -> None:
        """Nothing is left to do: each file was whole when its task ended."""

    def abort(self, messages) -> None:
        store, _ = self._store()
        for m in messages:
            if m is not None and m.path:
                store.delete_file(m.path)


class TrackLog(DataSource):
    SCHEMA, DECODE, ENCODE = FRAME, staticmethod(_frame), staticmethod(_frame_line)

    @classmethod
    def name(cls) -> str:
        return "track_log"

    def schema(self) -> str:
        return self.SCHEMA

    def reader(self, schema) -> Lines:
        return Lines(self.options["path"], int(self.options.get("range", RANGE)), self.DECODE)

    def writer(self, schema, overwrite: bool) -> LineWriter:
        return LineWriter(self.options["path"], self.ENCODE)


class Spans(TrackLog):
    SCHEMA, DECODE, ENCODE = SPAN, staticmethod(_span), staticmethod(_span_line)

    @classmethod
    def name(cls) -> str:
        return "spans"


def register(spark: SparkSession) -> None:
    """Makes both formats known to the session."""
    spark.dataSource.register(TrackLog)
    spark.dataSource.register(Spans)
