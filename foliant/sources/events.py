"""Server-sent events as a data source (S-10, S-11, M-03): files of lines
``data: {...}``, each followed by an empty line.

    spark.dataSource.register(EventSource)
    events.write.format("sse").option("path", path).mode("append").save()
    spark.read.format("sse").option("path", path).option("range", 1 << 26).load()

Tasks write parts under a name that readers pass over; the commit names them by
one rename each and puts down a list of them last, so a write that fails, or one
of a streaming trigger that is made again, leaves nothing that is read.  Readers
deal the files out in ranges of bytes: a range has the lines that begin in it and
reads on to the end of its last.  Files are reached through pyarrow's file
systems, by path or URI.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage

SCHEMA = "file string, at long, event string"
RANGE = 64 << 20
BLOCK = 1 << 20
PREFIX = b"data: "


def store(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a path or URI."""
    fs, place = pafs.FileSystem.from_uri(path)
    return fs, place.rstrip("/")


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: the name of its file and its events."""

    name: str
    events: int


@dataclass
class Bytes(InputPartition):
    file: str
    start: int
    end: int


class EventSource(DataSource):
    """``path`` is the folder; ``range`` the bytes a task reads; ``column`` the one
    that is written, of JSON texts."""

    @classmethod
    def name(cls) -> str:
        return "sse"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return EventReader(self.options["path"], int(self.options.get("range", RANGE)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return EventWriter(self.options["path"], self.options.get("column", "event"), overwrite)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return EventStreamWriter(self.options["path"], self.options.get("column", "event"))


class _Parts:
    """Writing of parts and their commit."""

    def __init__(self, path: str, column: str, overwrite: bool = False) -> None:
        self.path, self.column, self.overwrite = path, column, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        """A null event is left out; line feeds in an event can't stand in its
        line and are those between its tokens, so they become spaces."""
        fs, place = store(self.path)
        fs.create_dir(place, recursive=True)
        name, n = f"_part-{uuid.uuid4().hex}", 0
        with fs.open_output_stream(f"{place}/{name}") as out:
            for batch in iterator:
                for e in batch.column(batch.schema.get_field_index(self.column)).to_pylist():
                    if e is not None:
                        out.write(PREFIX + e.replace("\r", " ").replace("\n", " ").encode() + b"\n\n")
                        n += 1
        return Part(name, n)

    def publish(self, messages: list, name: str) -> None:
        """Gives parts their names and lists them under ``name``; parts listed
        there before, of the same trigger run once more, go."""
        fs, place = store(self.path)
        fs.create_dir(place, recursive=True)
        listed, done = f"{place}/_list-{name}", []
        before = names(fs, listed)
        for m in messages:
            if m is None:
                continue
            if m.events:
                fs.move(f"{place}/{m.name}", f"{place}/events-{m.name[6:]}")
                done.append(f"events-{m.name[6:]}")
            else:
                fs.delete_file(f"{place}/{m.name}")
        with fs.open_output_stream(f"{listed}.new") as out:
            out.write(json.dumps(done).encode())
        fs.move(f"{listed}.new", listed)
        for x in before:
            if x not in done:
                fs.delete_file(f"{place}/{x}")

    def drop(self, messages: list) -> None:
        fs, place = store(self.path)
        for m in messages:
            if m is not None and fs.get_file_info(f"{place}/{m.name}").type != pafs.FileType.NotFound:
                fs.delete_file(f"{place}/{m.name}")


def names(fs: pafs.FileSystem, listed: str) -> list[str]:
    if fs.get_file_info(listed).type == pafs.FileType.NotFound:
        return []
    with fs.open_input_stream(listed) as f:
        return json.loads(f.read())


class EventWriter(_Parts, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        if self.overwrite:
            fs, place = store(self.path)
            fs.create_dir(place, recursive=True)
            for x in fs.get_file_info(pafs.FileSelector(place)):
                if x.base_name.startswith(("events-", "_list-")):
                    fs.delete_file(x.path)
        self.publish(messages, uuid.uuid4().hex)

    def abort(self, messages: list) -> None:
        self.drop(messages)


class EventStreamWriter(_Parts, DataSourceStreamArrowWriter):
    """A trigger's list is named by its number, so that it counts once."""

    def commit(self, messages: list, batchId: int) -> None:
        self.publish(messages, f"batch-{batchId}")

    def abort(self, messages: list, batchId: int) -> None:
        self.drop(messages)


class EventReader(DataSourceReader):
    def __init__(self, path: str, size: int) -> None:
        self.path, self.size = path, size

    def partitions(self) -> list[Bytes]:
        fs, place = store(self.path)
        found = {x.base_name: x for x in fs.get_file_info(pafs.FileSelector(place)) if x.is_file}
        kept = {n for x in found if x.startswith("_list-") and not x.endswith(".new") for n in names(fs, f"{place}/{x}")}
        return [Bytes(n, a, min(a + self.size, found[n].size)) for n in sorted(kept & found.keys()) for a in range(0, found[n].size, self.size)]

    def read(self, partition: Bytes) -> Iterator[pa.RecordBatch]:
        """(file, byte at which it begins, event) of the well-formed events whose
        line begins in the range."""
        fs, place = store(self.path)
        out: list[tuple[int, str]] = []
        with fs.open_input_file(f"{place}/{partition.file}") as f:
            for at, line in lines(f, partition.start, partition.end):
                if line.startswith(PREFIX) and _well_formed(line[len(PREFIX) :]):
                    out.append((at, line[len(PREFIX) :].decode("utf-8", "replace")))
                if len(out) >= 1000:
                    yield _batch(partition.file, out)
                    out = []
        yield _batch(partition.file, out)


def lines(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(position, line) of the lines of an open file that begin in a range of
    bytes; the last is read to its end, beyond the range; one that the file ends
    in without a line feed isn't written yet."""
    at = max(start - 1, 0)  # a line begins at start if a line feed stands before it
    f.seek(at)
    held = b""
    skip = start > 0
    while True:
        cut = held.find(b"\n")
        while cut < 0:
            more = f.read(BLOCK)
            if not more:
                return
            seen = len(held)
            held += more
            cut = held.find(b"\n", seen)
        got = held.split(b"\n")
        held = got.pop()
        for line in got:
            if skip:
                skip = False
            elif at >= end:
                return
            else:
                yield at, line
            at += len(line) + 1
        if at >= end:
            return


def _well_formed(event: bytes) -> bool:
    try:
        json.loads(event)
    except ValueError:
        return False
    return True


def _batch(file: str, rows: list[tuple[int, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(rows), pa.string()), pa.array([a for a, _ in rows], pa.int64()), pa.array([e for _, e in rows], pa.string())], ["file", "at", "event"])
