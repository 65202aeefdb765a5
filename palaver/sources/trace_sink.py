"""The turn trace as a sink that rotates.

Rows are written as JSON lines below the path: ``current`` holds the newest files and ``1`` to ``3`` the generations before it.
When the files of a job would carry ``current`` beyond ``max_bytes``, generations move up by one and the oldest goes.  Tasks
write below ``_jobs/<job>``; the driver moves their files when all have succeeded, and removes the folder if one has failed,
so a failed job or a lost executor leaves nothing that a reader sees.

    spark.dataSource.register(TraceSink)
    trace.write.format("turn_trace").mode("append").save(path)

The path has to be in a folder that driver and executors share; it may be one of pyarrow's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from palaver import schemas as S
from palaver.sources.cursor import file_system

MAX_BYTES, GENERATIONS = 10 << 20, 3
CURRENT, JOBS = "current", "_jobs"


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    size: int


class TraceWriter(DataSourceWriter):
    def __init__(self, path: str, max_bytes: int, generations: int):
        self.path, self.max_bytes, self.generations, self.job = path, max_bytes, generations, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Written:
        system, root = file_system(self.path)
        folder, file = f"{root}/{JOBS}/{self.job}", None
        size = 0
        for row in iterator:
            if file is None:
                system.create_dir(folder, recursive=True)
                path = f"{folder}/part-{uuid.uuid4().hex}.json"  # of this attempt alone
                file = system.open_output_stream(path)
            line = json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str).encode() + b"\n"
            file.write(line)
            size += len(line)
        if file is None:
            return Written(None, 0)
        file.close()
        return Written(path, size)

    def commit(self, messages: list) -> None:
        system, root = file_system(self.path)
        held = self.held(system, f"{root}/{CURRENT}")
        for m in messages:
            if m is None or m.path is None:
                continue
            if held and held + m.size > self.max_bytes:
                self.rotate(system, root)
                held = 0
            system.create_dir(f"{root}/{CURRENT}", recursive=True)
            system.move(m.path, f"{root}/{CURRENT}/{m.path.rpartition('/')[2]}")
            held += m.size
        self.clean(system, root)

    def abort(self, messages: list) -> None:
        self.clean(*file_system(self.path))

    def held(self, system, folder: str) -> int:
        from pyarrow import fs

        return sum(f.size for f in system.get_file_info(fs.FileSelector(folder, allow_not_found=True)) if f.is_file)

    def rotate(self, system, root: str) -> None:
        from pyarrow import fs

        names = [CURRENT, *(str(g) for g in range(1, self.generations + 1))]
        there = lambda n: system.get_file_info(f"{root}/{n}").type == fs.FileType.Directory
        if there(names[-1]):
            system.delete_dir(f"{root}/{names[-1]}")
        for older, newer in zip(reversed(names), reversed(names[:-1]), strict=False):
            if there(newer):
                system.move(f"{root}/{newer}", f"{root}/{older}")

    def clean(self, system, root: str) -> None:
        from pyarrow import fs

        if system.get_file_info(f"{root}/{JOBS}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/{JOBS}/{self.job}")


class TraceSink(DataSource):
    """Options: path; max_bytes; generations."""

    @classmethod
    def name(cls) -> str:
        return "turn_trace"

    def schema(self) -> str:
        return S.TRACE

    def writer(self, schema, overwrite: bool) -> TraceWriter:
        return TraceWriter(self.options["path"], int(self.options.get("max_bytes", MAX_BYTES)), int(self.options.get("generations", GENERATIONS)))


def read_rotated(spark: SparkSession, path: str, generations: int = GENERATIONS) -> DataFrame:
    """All generations that are there; unreadable lines are left out."""
    from pyarrow import fs

    system, root = file_system(path)
    names = [n for n in (CURRENT, *map(str, range(1, generations + 1))) if system.get_file_info(f"{root}/{n}").type == fs.FileType.Directory]
    if not names:
        return spark.createDataFrame([], S.TRACE)
    return spark.read.schema(S.TRACE).option("mode", "DROPMALFORMED").json([f"{path}/{n}" for n in names])
