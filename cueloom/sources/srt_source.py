"""SRT files as a data source, `spark.read.format("srt")`: one row per block, read by byte ranges.

A long file (a merged corpus) is cut into ranges of splitBytes; small files share a partition. A block
belongs to the range that its first byte lies in: a reader looks for the end of the first separator (two
or more line ends of any kind) that reaches its range, and reads on behind the range to the end of its
last block. So it holds one block and two chunks, never a file.

Columns: audio_id (the file's name without extension), path, pos (the block's first byte) and lines.
A schema given by the caller with some of them makes only these. Options: pathGlobFilter (*.srt), which
chooses files before any is opened, and splitBytes. Conditions aren't pushed down: Spark 4.1.2 keeps a
reader's pushed filters for the relation, so another query on the same DataFrame would lose rows.

Files are listed and read by Arrow's file systems (local, hdfs, s3, gs); for other stores there is
`subtitles.read_files`. Bytes that aren't UTF-8 become U+FFFD.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "audio_id string, path string, pos long, lines array<string>"
SPLIT_BYTES = 32 << 20
CHUNK = 1 << 20
#: Blocks in one Arrow batch.
BATCH = 2048
#: A line end is taken whole, so that \r\n never counts as two.
SEPARATOR = re.compile(rb"(?>\r\n|\n|\r){2,}")
#: Two line ends have at most so many bytes.
REACH = 4
BLANK = " \t\n\x0b\f\r"


@dataclass
class Ranges(InputPartition):
    """(path, first byte, end) of each range that a task reads."""

    spans: tuple[tuple[str, int, int], ...]

    def __post_init__(self) -> None:
        super().__init__(self.spans)


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path there. file:/x and file:///x are the same."""
    if re.match(r"file:/(?!/)", path):
        path = path[len("file:") :]
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def stem(path: str) -> str:
    return re.sub(r"(?<=.)\.[^.]*$", "", path.rsplit("/", 1)[-1])


def block_lines(raw: bytes, first: bool) -> list[str]:
    text = raw.decode("utf-8", "replace")
    if first:
        text = text.removeprefix("﻿")
    return re.sub("\r\n?", "\n", text).strip(BLANK).split("\n")


def blocks_of(file, start: int, end: int, size: int) -> Iterator[tuple[int, bytes]]:
    """(pos, bytes) of the blocks whose first byte is in [start, end). An empty file has one empty block."""
    base = max(0, start - REACH)
    file.seek(base)
    held, over = b"", False

    def more() -> None:
        nonlocal held, over
        got = file.read(CHUNK)
        held, over = held + got, not got

    def separator(at: int) -> re.Match | None:
        """The first one from `at` on whose end is sure."""
        while True:
            m = SEPARATOR.search(held, at)
            if over or (m and m.end() < len(held)):
                return m
            at = m.start() if m else max(at, len(held) - REACH)  # a run that touches the end may go on
            more()

    at = 0
    if start > 0:  # the block that runs into this range is another's
        while True:
            m = separator(at)
            if not m:
                return
            at = m.end()
            if base + at >= start:
                break
    while base + at < end and (base + at < size or base + at == 0):
        if at >= CHUNK:
            base, held, at = base + at, held[at:], 0
        m = separator(at)
        yield base + at, held[at : m.start() if m else len(held)]
        if not m:
            return
        at = m.end()


class SrtReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.columns, self.schema = schema.names, schema
        self.path, self.glob = options["path"], options.get("pathglobfilter", options.get("pathGlobFilter", "*.srt"))
        self.split = int(options.get("splitbytes", options.get("splitBytes", SPLIT_BYTES)))

    def _files(self) -> list[fs.FileInfo]:
        store, path = opened(self.path)
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path))
        named = [f for f in found if f.is_file and (info.is_file or (fnmatch.fnmatch(f.base_name, self.glob) and f.base_name[0] not in "._"))]
        return sorted(named, key=lambda f: f.path)

    def partitions(self) -> list[Ranges]:
        out, held, size = [], [], 0
        for f in self._files():
            for start in range(0, max(f.size, 1), self.split):
                end = min(start + self.split, max(f.size, 1))
                if held and size + end - start > self.split:
                    out.append(Ranges(tuple(held)))
                    held, size = [], 0
                held.append((f.path, start, end))
                size += end - start
        return out + [Ranges(tuple(held))]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        kinds = {"audio_id": pa.string(), "path": pa.string(), "pos": pa.int64(), "lines": pa.list_(pa.string())}
        shape = pa.schema([(c, kinds[c]) for c in self.columns])
        held: list[dict] = []
        store, _ = opened(self.path)
        for path, start, end in partition.spans:
            name = stem(path)
            with store.open_input_file(path) as file:
                for pos, raw in blocks_of(file, start, end, file.size()):
                    held.append({"audio_id": name, "path": path, "pos": pos, "lines": block_lines(raw, pos == 0) if "lines" in self.columns else None})
                    if len(held) == BATCH:
                        yield pa.RecordBatch.from_pylist(held, shape)
                        held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, shape)


class SrtSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "srt"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> SrtReader:
        return SrtReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(SrtSource)


def read_blocks(spark: SparkSession, path: str, *, glob: str = "*.srt", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """audio_id, path, pos, lines of all SRT files in path; `subtitles`' parsers take it in place of whole files."""
    register(spark)
    return spark.read.format("srt").option("pathGlobFilter", glob).option("splitBytes", split_bytes).load(path)
