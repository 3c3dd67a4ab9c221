"""A stream of the entries of files that grow: JSON lines to which hosts append.

The offset of the stream says for each file how many bytes were read (always whole lines) and what the last entry
was. A line without its line feed waits. A file whose last entry read isn't there any more was rewritten or cut,
and is read again from its beginning; what is delivered twice by that, ``once`` removes.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "file STRING, at BIGINT, entry_hash STRING, value STRING"
#: Bytes that are read at once, rows of an Arrow batch, and bytes of a file that one task reads (an option).
CHUNK, ROWS, TASK_BYTES = 1 << 16, 1000, 64 << 20


def digest(entry: bytes) -> str:
    return hashlib.blake2b(entry, digest_size=16).hexdigest()


def file_system(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def last_entry(f, end: int) -> tuple[int, int, str]:
    """(end, length, digest) of the last whole line that ends at or before byte ``end``; zeros if there is none.

    Reads backwards from the end, as far as that line is long.
    """
    tail, start = b"", end
    while start > 0 and (tail.count(b"\n") < 2):
        step = min(CHUNK, start)
        f.seek(start - step)
        tail, start = f.read(step) + tail, start - step
    stop = tail.rfind(b"\n")
    if stop < 0:
        return 0, 0, ""
    entry = tail[tail.rfind(b"\n", 0, stop) + 1 : stop + 1]
    return start + stop + 1, len(entry), digest(entry)


class Range(InputPartition):
    def __init__(self, file: str, begin: int, end: int, first: bool):
        self.file, self.begin, self.end, self.first = file, begin, end, first


class GrowingSource(DataSource):
    """Format ``growing_lines``: option path (a folder or file), suffix (``.jsonl``), task_bytes."""

    @classmethod
    def name(cls):
        return "growing_lines"

    def schema(self):
        return SCHEMA

    def streamReader(self, schema):
        return GrowingReader(dict(self.options))


class GrowingReader(DataSourceStreamReader):
    """Offsets are ``{"files": {path: [bytes, length of the last entry, its digest]}}``.

    Files that are gone leave the offset, so its size follows the files that are there.
    """

    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".jsonl")
        self.task_bytes = int(options.get("task_bytes", TASK_BYTES))
        self.known: dict[str, tuple] = {}

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        """Only files whose size or time changed since the last call are opened, and only their ends are read."""
        from pyarrow import fs

        system, root = file_system(self.path)
        info = system.get_file_info(root)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        now = {}
        for x in found:
            if x.type == fs.FileType.File and x.path.endswith(self.suffix):
                mark = (x.size, x.mtime_ns)
                if self.known.get(x.path, (None,))[0] != mark:
                    with system.open_input_file(x.path) as f:
                        self.known[x.path] = (mark, list(last_entry(f, x.size)))
                now[x.path] = self.known[x.path][1]
        self.known = {p: self.known[p] for p in now}
        return {"files": {p: now[p] for p in sorted(now)}}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, _ = file_system(self.path)
        out = []
        for path, (stop, _, last) in end["files"].items():
            begin, length, before = start["files"].get(path, (0, 0, ""))
            if (begin, before) == (stop, last):
                continue
            if begin and not self._continues(system, path, begin, length, before):
                begin = 0
            cuts = [*range(begin, stop, self.task_bytes), stop]
            out += [Range(path, a, b, a == begin) for a, b in zip(cuts, cuts[1:])]
        return out

    def _continues(self, system, path: str, begin: int, length: int, before: str) -> bool:
        with system.open_input_file(path) as f:
            if f.size() < begin:
                return False
            f.seek(begin - length)
            return digest(f.read(length)) == before

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """The lines that begin inside the range; the byte before it tells whether its first byte begins one."""
        system, _ = file_system(self.path)
        rows: list[tuple] = []
        with system.open_input_stream(partition.file) as f:
            at = partition.begin if partition.first else partition.begin - 1
            f.seek(at) if f.seekable() else f.read(at)
            rest, skipping = b"", not partition.first
            while at < partition.end:
                block = f.read(CHUNK)
                if not block:
                    return_rows, rows = rows, []
                    if return_rows:
                        yield self._batch(return_rows)
                    return
                lines = (rest + block).split(b"\n")
                rest = lines.pop()
                for line in lines:
                    if at >= partition.end:
                        break
                    if not skipping:
                        rows.append((partition.file, at, digest(line + b"\n"), line))
                    skipping = False
                    at += len(line) + 1
                    if len(rows) >= ROWS:
                        yield self._batch(rows)
                        rows = []
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        file, at, entry, line = zip(*rows)
        text = [x.decode("utf-8", "replace") for x in line]
        return pa.RecordBatch.from_arrays([pa.array(file, pa.string()), pa.array(at, pa.int64()), pa.array(entry, pa.string()), pa.array(text, pa.string())], names=["file", "at", "entry_hash", "value"])


def entries(spark: SparkSession, path: str, **options) -> DataFrame:
    """A stream of (file, at, entry_hash, value): each whole line below ``path``, with the byte where it begins."""
    spark.dataSource.register(GrowingSource)
    return spark.readStream.format("growing_lines").options(path=path, **options).load()


def once(stream: DataFrame) -> DataFrame:
    """Each entry of a place once, whatever was rewritten around it: the entries seen are the stream's keyed state."""
    return stream.dropDuplicates(["file", "at", "entry_hash"])
