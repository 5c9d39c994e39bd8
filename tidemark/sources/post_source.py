"""Posts from several folders as one Spark data source, by batch and by stream; a broken source is reported, never fatal.

Each source is a folder of JSON-lines files (any store that pyarrow knows by its URI). A file is a partition. A stream's offset
holds, for each source, the last file read in the order of names and the source's error, so a source that breaks or heals is
itself an event that the stream reports once. Files are taken as whole once listed, and new ones must sort after old ones.

A source that can't be listed gives one row with its error; a line that is no post gives one row with its place, and the
other lines of its file are kept. `fetch` and `follow` part posts from failures.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

NAME = "tidemark_posts"
SCHEMA = "source string, external_id string, created_at timestamp, author string, symbol string, text string, engagement double, error string"


@dataclass
class FilePart(InputPartition):
    source: str
    path: str | None
    error: str | None = None


def _files(uri: str) -> list[str]:
    """Names of a folder's JSON-lines files in order."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    found = system.get_file_info(fs.FileSelector(path, recursive=False))
    return sorted(x.base_name for x in found if x.type == fs.FileType.File and x.base_name.endswith(".jsonl"))


def _lines(uri: str) -> Iterator[bytes]:
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_stream(path) as f:
        rest = b""
        while part := f.read(1 << 20):
            *whole, rest = (rest + part).split(b"\n")
            yield from whole
        if rest:
            yield rest


def _post(source: str, raw: bytes) -> tuple:
    d = json.loads(raw)
    at = dt.datetime.fromisoformat(d["created_at"])
    at = at if at.tzinfo else at.replace(tzinfo=dt.UTC)
    text = lambda k: None if d.get(k) is None else str(d[k])
    return source, str(d["external_id"]), at, text("author"), text("symbol"), text("text"), float(d.get("engagement") or 0.0), None


def _read(part: FilePart) -> Iterator[tuple]:
    failed = lambda e: (part.source, None, None, None, None, None, None, e)
    if part.path is None:
        yield failed(part.error)
        return
    number = 0
    try:
        for number, raw in enumerate(_lines(part.path), 1):
            if raw.strip():
                try:
                    yield _post(part.source, raw)
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    yield failed(f"{part.path.rsplit('/', 1)[-1]} line {number}: {type(e).__name__}")
    except OSError as e:
        yield failed(f"{part.path.rsplit('/', 1)[-1]} after line {number}: {type(e).__name__}")


class _Reader(DataSourceReader):
    def __init__(self, sources: dict[str, str]):
        self.sources = sources

    def partitions(self) -> list[FilePart]:
        out: list[FilePart] = []
        for name, uri in self.sources.items():
            try:
                out += [FilePart(name, f"{uri}/{f}") for f in _files(uri)]
            except (OSError, ValueError) as e:
                out.append(FilePart(name, None, type(e).__name__))
        return out or [FilePart("", None, "no sources")] if not self.sources else out

    def read(self, partition: FilePart) -> Iterator[tuple]:
        return _read(partition) if partition is not None else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, sources: dict[str, str]):
        self.sources = sources

    def initialOffset(self) -> dict:
        return {name: {"last": "", "error": None} for name in self.sources}

    def latestOffset(self, *_) -> dict:
        out = {}
        for name, uri in self.sources.items():
            try:
                out[name] = {"last": max(_files(uri), default=""), "error": None}
            except (OSError, ValueError) as e:
                out[name] = {"last": None, "error": type(e).__name__}
        self.known = getattr(self, "known", self.initialOffset())
        for name, at in out.items():  # a source that can't be listed stays where it was
            at["last"] = self.known[name]["last"] if at["last"] is None else max(at["last"], self.known[name]["last"])
        self.known = out
        return out

    def partitions(self, start: dict, end: dict) -> list[FilePart]:
        self.known = end
        out: list[FilePart] = []
        for name, to in end.items():
            since = start.get(name) or {"last": "", "error": None}
            if to["error"] and to["error"] != since["error"]:
                out.append(FilePart(name, None, to["error"]))
            elif not to["error"] and to["last"] > since["last"]:
                out += [FilePart(name, f"{self.sources[name]}/{f}") for f in _files(self.sources[name]) if since["last"] < f <= to["last"]]
        return out

    def read(self, partition: FilePart) -> Iterator[tuple]:
        return _read(partition)


class PostSource(DataSource):
    """Option `sources`: a JSON object of names and folders."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def _sources(self) -> dict[str, str]:
        return {k: v.rstrip("/") for k, v in json.loads(self.options["sources"]).items()}

    def reader(self, schema) -> _Reader:
        return _Reader(self._sources())

    def streamReader(self, schema) -> _StreamReader:
        return _StreamReader(self._sources())


def _parted(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.where("error is null").drop("error"), rows.where("error is not null").select("source", "error")


def fetch(spark: SparkSession, sources: dict[str, str], since: dt.datetime | None = None, until: dt.datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """Posts of all sources in (since, until], each (source, external_id) once, and what failed where."""
    spark.dataSource.register(PostSource)
    posts, failures = _parted(spark.read.format(NAME).option("sources", json.dumps(sources)).load())
    if since is not None:
        posts = posts.where(F.col("created_at") > F.lit(since))
    if until is not None:
        posts = posts.where(F.col("created_at") <= F.lit(until))
    return posts.dropDuplicates(["source", "external_id"]), failures


def follow(spark: SparkSession, sources: dict[str, str], horizon: str = "72 hours") -> tuple[DataFrame, DataFrame]:
    """The same as streams: posts once each within the horizon, and failures as they come up."""
    spark.dataSource.register(PostSource)
    stream = lambda: spark.readStream.format(NAME).option("sources", json.dumps(sources)).load()
    posts, _ = _parted(stream())
    _, failures = _parted(stream())
    return posts.withWatermark("created_at", horizon).dropDuplicatesWithinWatermark(["source", "external_id"]), failures
