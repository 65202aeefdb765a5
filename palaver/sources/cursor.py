"""Message buffers as a streaming source with a cursor per buffer.

A host keeps the messages of a session in a buffer that grows, and now and then begins anew with a shorter one.  Here a
buffer is a file of JSON lines below the source's path, named after its session.  Where sessions are many, a buffer holds those
of many sessions, each line with its ``session_id``, so that buffers, cursors and tasks grow with the bytes and not with the sessions
(:func:`write_buffers`).  The offset of the stream is the cursor of
every buffer, in bytes up to its last whole line; a buffer that is shorter than its cursor is read again from its start.
Only the ends of buffers are looked at on the driver; lines are read by tasks, each of a range of at most ``RANGE`` bytes,
cut at lines.  The stream's checkpoint keeps the cursors, so a message is handed on once, also after a restart.

    spark.dataSource.register(MessageBuffers)
    spark.readStream.format("message_buffers").load("/shared/buffers")

Paths are those of pyarrow's file systems (local and shared folders, hdfs://, s3://).  Lines that are not JSON objects are left
out.  One row a message: session_id (the line's, else the buffer's), at (the line's first byte, which orders a buffer), role, content, name.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RANGE = 32 << 20
#: Bytes that are read at a time when the end of the last whole line is looked for.
TAIL = 1 << 16
FIELDS = ("role", "content", "name")


@dataclass
class Range(InputPartition):
    """Lines of a buffer that begin in [start, stop)."""

    session: str
    path: str
    start: int
    stop: int
    end: int  # of what the cursor has reached


def file_system(path: str):
    from pyarrow import fs

    if path.startswith("file:"):  # Hadoop writes one slash or three
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def buffers(path: str) -> dict[str, tuple[str, int]]:
    """session -> (file, size)."""
    from pyarrow import fs

    system, root = file_system(path)
    found = system.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return {f.base_name.removesuffix(".jsonl"): (f.path, f.size) for f in found if f.is_file and f.base_name.endswith(".jsonl")}


def whole_lines(path: str, file: str, size: int) -> int:
    """The end of the last whole line among the first *size* bytes."""
    system, _ = file_system(path)
    with system.open_input_file(file) as f:
        at = size
        while at > 0:
            low = max(0, at - TAIL)
            cut = f.read_at(at - low, low).rfind(b"\n")
            if cut >= 0:
                return low + cut + 1
            at = low
    return 0


def read_lines(path: str, part: Range) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines that begin in the range; one that begins before it belongs to the range before."""
    system, _ = file_system(path)
    with io.BufferedReader(system.open_input_file(part.path), 1 << 18) as f:
        at = part.start
        if at > 0:
            f.seek(at - 1)
            at += len(f.readline()) - 1
        f.seek(at)
        while at < part.stop and at < part.end:
            line = f.readline()
            if not line:
                break
            yield at, line
            at += len(line)


def write_buffers(lines: DataFrame, path: str) -> None:
    """Write lines (session_id, msg_index, line) as one buffer a task, each session in one buffer and in order."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(path)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(f"{root}/part-{TaskContext.get().partitionId():06d}.jsonl") as f:
            for batch in batches:
                f.write("".join(line + "\n" for line in batch.column(0).to_pylist()).encode())
        yield from ()

    dealt = lines.repartition("session_id").sortWithinPartitions("session_id", "msg_index").select("line")
    dealt.mapInArrow(put, "line string").write.format("noop").mode("overwrite").save()


class BufferReader:
    def __init__(self, path: str, width: int = RANGE):
        self.path, self.width = path, width

    def cursors(self, known: dict[str, int]) -> dict[str, int]:
        out = {}
        for session, (file, size) in buffers(self.path).items():
            # nothing after a cursor that is where the buffer ends
            out[session] = size if known.get(session) == size else whole_lines(self.path, file, size)
        return out

    def ranges(self, start: dict[str, int], end: dict[str, int]) -> list[Range]:
        files, out = buffers(self.path), []
        for session, stop in sorted(end.items()):
            at = start.get(session, 0)
            at = 0 if at > stop else at
            if session in files:
                out += [Range(session, files[session][0], a, min(a + self.width, stop), stop) for a in range(at, stop, self.width)]
        return out

    def rows(self, part: Range) -> Iterator[tuple]:
        for at, line in read_lines(self.path, part):
            try:
                message = json.loads(line)
            except ValueError:
                continue
            if isinstance(message, dict):
                named = message.get("session_id")
                yield (part.session if named is None else str(named), at, *(v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False) for v in map(message.get, FIELDS)))


class StreamReader(BufferReader, DataSourceStreamReader):
    def __init__(self, path: str, width: int = RANGE):
        BufferReader.__init__(self, path, width)
        self.last: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        self.last = self.cursors(self.last)
        return self.last

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return self.ranges(start, end)

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.rows(partition)

    def commit(self, end: dict) -> None:
        self.last = self.last or end


class BatchReader(BufferReader, DataSourceReader):
    def partitions(self) -> list[Range]:
        return self.ranges({}, self.cursors({}))

    def read(self, partition: Range) -> Iterator[tuple]:
        return self.rows(partition)


class MessageBuffers(DataSource):
    """Options: path; range, the most bytes that one task reads."""

    @classmethod
    def name(cls) -> str:
        return "message_buffers"

    def schema(self) -> str:
        return "session_id string, at long, role string, content string, name string"

    def reader(self, schema) -> BatchReader:
        return BatchReader(self.options["path"], int(self.options.get("range", RANGE)))

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options["path"], int(self.options.get("range", RANGE)))
