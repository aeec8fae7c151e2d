"""Lazy frames: a Python data source over folders with a list of timed frames.

A clip is a folder with a list, `frames.txt`: one frame a line, its time in seconds and the path
of its image, relative to the list; lines that begin with # are comments. The source gives frames
in the order of the list, with times measured from the first one. An image's bytes are read when
its row is, and only if the schema that was asked for has `image`; times and indexes alone read no
image. Conditions on clip, frame_index and time_seconds are pushed into the source: clips that
can't match are not opened, images of frames that don't match are not read.

As a stream, a clip is read once, when its list has appeared or changed; the offset is the time
of the newest list. Files are reached through pyarrow's file systems, so the folder may lie in
any store that they reach; each task reads its own share of one list.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.types import StructType

SCHEMA = "clip string, frame_index long, time_seconds double, image binary"
LIST = "frames.txt"


@dataclass
class Share(ds.InputPartition):
    """The n-th of `of` equal shares of a clip's frames."""

    clip: str
    path: str
    n: int
    of: int


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _lists(root: str) -> list[fs.FileInfo]:
    """The lists of all clips, in order of their folders."""
    store, path = _store(root)
    found = [f for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if f.is_file and f.base_name == LIST]
    return sorted(found, key=lambda f: f.path)


def read_list(text: str, clip: str) -> list[tuple[float, str]]:
    """(time, path) of each frame; a line without a time is an error, as times are never guessed."""
    out = []
    for line in text.splitlines():
        if not line.strip() or line.startswith("#"):
            continue
        time, _, path = line.strip().partition(" ")
        try:
            out.append((float(time), path.strip()))
        except ValueError:
            raise ValueError(f"{clip}: frame {len(out)} has no timestamp, and its time is not guessed") from None
    return out


_PUSHED = {
    ds.EqualTo: lambda x, y: x == y,
    ds.GreaterThan: lambda x, y: x > y,
    ds.GreaterThanOrEqual: lambda x, y: x >= y,
    ds.LessThan: lambda x, y: x < y,
    ds.LessThanOrEqual: lambda x, y: x <= y,
    ds.In: lambda x, y: x in y,
}


class _Frames:
    """What batch and stream readers share."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.columns = schema.names
        unknown = set(self.columns) - {"clip", "frame_index", "time_seconds", "image"}
        if unknown:
            raise ValueError(f"frames have no {', '.join(sorted(unknown))}")
        if "path" not in options:
            raise ValueError("the folder of the clips is missing: load(path)")
        self.root = options["path"]
        self.stride = int(options.get("stride", "1"))
        self.share_bytes = int(options.get("shareBytes", str(1 << 20)))
        self.conditions: list[tuple[str, str, object]] = []
        self.arrow = pa.schema([("clip", pa.string()), ("frame_index", pa.int64()), ("time_seconds", pa.float64()), ("image", pa.binary())])

    def holds(self, name: str, value: object) -> bool:
        return all(_PUSHED[getattr(ds, kind)](value, wanted) for column, kind, wanted in self.conditions if column == name)

    def shares(self, lists: Iterable[fs.FileInfo]) -> list[Share]:
        out = []
        for f in lists:
            clip = f.path.rsplit("/", 2)[-2]
            if self.holds("clip", clip):
                of = max(1, -(-f.size // self.share_bytes))
                out += [Share(clip, f.path, n, of) for n in range(of)]
        return out

    def read(self, share: Share) -> Iterator[pa.RecordBatch]:
        if share.of < 1:
            return
        store, _ = _store(self.root)
        with store.open_input_stream(share.path) as lines:
            frames = read_list(lines.read().decode(), share.clip)
        start = frames[0][0] if frames else 0.0
        folder = share.path.rsplit("/", 1)[0]
        rows: list[tuple] = []
        size = 0
        for index in range(len(frames) * share.n // share.of, len(frames) * (share.n + 1) // share.of):
            time, path = frames[index][0] - start, frames[index][1]
            if index % self.stride or not self.holds("frame_index", index) or not self.holds("time_seconds", time):
                continue
            image = None
            if "image" in self.columns:
                with store.open_input_stream(f"{folder}/{path}") as f:
                    image = f.read()
                size += len(image)
            rows.append((share.clip, index, time, image))
            if len(rows) >= 10_000 or size >= 8 << 20:  # a few images at a time
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        columns = dict(zip(self.arrow.names, zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], self.arrow.field(c).type) for c in self.columns], self.columns)


class FrameReader(_Frames, ds.DataSourceReader):
    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for f in filters:
            column = getattr(f, "attribute", None)
            if type(f) in _PUSHED and column is not None and len(column) == 1 and column[0] in ("clip", "frame_index", "time_seconds"):
                self.conditions.append((column[0], type(f).__name__, f.value))
            elif isinstance(f, ds.IsNotNull) and f.attribute[0] in ("clip", "frame_index", "time_seconds"):
                continue  # never NULL
            else:
                yield f

    def partitions(self) -> Sequence[Share]:
        # a scan without partitions is not allowed to have none
        return self.shares(_lists(self.root)) or [Share("", "", 0, 0)]


class FrameStream(_Frames, ds.DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"newest": 0}

    def latestOffset(self) -> dict:
        return {"newest": max((f.mtime_ns for f in _lists(self.root)), default=0)}

    def partitions(self, start: dict, end: dict) -> Sequence[Share]:
        return self.shares(f for f in _lists(self.root) if start["newest"] < f.mtime_ns <= end["newest"]) or [Share("", "", 0, 0)]

    def commit(self, end: dict) -> None:
        pass


class FrameLists(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_lists"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(schema, self.options)

    def streamReader(self, schema: StructType) -> FrameStream:
        return FrameStream(schema, self.options)


def register(spark: SparkSession) -> None:
    """`spark.read.format("frame_lists")`, with conditions pushed into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameLists)


def frames(spark: SparkSession, path: str, stride: int = 1, schema: str = SCHEMA) -> DataFrame:
    """Every `stride`-th frame of the clips below `path`; only the columns of `schema` are read."""
    register(spark)
    return spark.read.format("frame_lists").schema(schema).option("stride", stride).load(path)


def frame_times(spark: SparkSession, path: str) -> DataFrame:
    """(clip, frame_index, time_seconds): no image is read."""
    return frames(spark, path, schema="clip string, frame_index long, time_seconds double")


def frame_stream(spark: SparkSession, path: str, stride: int = 1, schema: str = SCHEMA) -> DataFrame:
    register(spark)
    return spark.readStream.format("frame_lists").schema(schema).option("stride", stride).load(path)
