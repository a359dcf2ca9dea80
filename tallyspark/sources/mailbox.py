"""A mailbox of captured message files as a streaming source: reading is polled, a commit marks messages as read.

Messages arrive as files of one JSON record a line, which appear under their names at once (written elsewhere and renamed).
``_journal`` keeps the order in which the source has met them: an entry for each poll, whose number is the offset. The
entries of a batch name its files, so a batch that is run again has the messages of the first run, whatever has arrived since.
Once Spark has a batch behind it, ``commit`` moves the files of its entries to ``_read``, as a mailbox drops the unread
label; until then they stay. One query reads a mailbox at a time.

``spark.readStream.format("mailbox").option("path", folder)``; with ``filesPerPoll`` a poll takes so many files at most (one
batch of a trigger by time; a trigger ``availableNow`` is one poll). Rows are (file, position, value): the record's file,
its line from 0, and its raw text. Blank lines are left out. Bytes that aren't UTF-8 become replacement signs.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from . import folders

RECORD = "file STRING, position BIGINT, value STRING"
#: Bytes and files that a task reads, about, and bytes of a batch of rows.
TASK_BYTES, TASK_FILES, BATCH_BYTES = 32 << 20, 1000, 1 << 20


@dataclass
class Files(InputPartition):
    names: tuple[str, ...]


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str, per_poll: int | None):
        self.path, self.per_poll = path, per_poll
        self.met: set[str] | None = None

    def _entry(self, number: int) -> str:
        return f"{folders.opened(self.path)[1]}/_journal/{number:020d}"

    def _entries(self) -> list[int]:
        system, path = folders.opened(self.path)
        return [int(name) for f in folders.listed(system, f"{path}/_journal") if (name := f.base_name).isdigit()]

    def _read_up_to(self) -> int:
        system, path = folders.opened(self.path)
        mark = f"{path}/_journal/read"
        return int(folders.content(system, mark)) if folders.exists(system, mark) else 0

    def initialOffset(self) -> dict:
        return {"entry": self._read_up_to()}

    def latestOffset(self) -> dict:
        system, path = folders.opened(self.path)
        entries = self._entries()
        end = max([self._read_up_to(), *(n + 1 for n in entries)])
        if self.met is None:  # what earlier polls have taken and no commit has moved yet
            self.met = {name for n in entries for name in json.loads(folders.content(system, self._entry(n)))}
        here = [f.base_name for f in folders.listed(system, path) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        self.met.intersection_update(here)
        new = [name for name in here if name not in self.met][: self.per_poll]
        if not new:
            return {"entry": end}
        system.create_dir(f"{path}/_journal")
        folders.replaced(system, self._entry(end), json.dumps(new).encode())
        self.met.update(new)
        return {"entry": end + 1}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        system, path = folders.opened(self.path)
        names = [name for n in range(start["entry"], end["entry"]) for name in json.loads(folders.content(system, self._entry(n)))]
        parts, size = [[]], 0
        for info in system.get_file_info([f"{path}/{name}" for name in names]):
            if parts[-1] and (size + (info.size or 0) > TASK_BYTES or len(parts[-1]) == TASK_FILES):
                parts.append([])
                size = 0
            parts[-1].append(info.base_name)
            size += info.size or 0
        return [Files(tuple(p)) for p in parts if p]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, path = folders.opened(self.path)
        names = [c.split()[0] for c in RECORD.split(", ")]
        for name in partition.names:
            moved = not folders.exists(system, f"{path}/{name}")  # by a commit that another query's end has cut short
            with system.open_input_stream(f"{path}/_read/{name}" if moved else f"{path}/{name}") as file:
                rows, size, rest, line = [], 0, b"", 0
                while True:
                    data = file.read(BATCH_BYTES)
                    lines = (rest + data).split(b"\n")
                    rest = lines.pop() if data else b""
                    for raw in lines:
                        if raw.strip():
                            rows.append((name, line, raw.rstrip(b"\r").decode(errors="replace")))
                            size += len(raw)
                        line += 1
                    if rows and (size >= BATCH_BYTES or not data):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], names)
                        rows, size = [], 0
                    if not data:
                        break

    def commit(self, end: dict) -> None:
        system, path = folders.opened(self.path)
        system.create_dir(f"{path}/_read")
        for n in self._entries():
            if n < end["entry"]:
                for name in json.loads(folders.content(system, self._entry(n))):
                    if folders.exists(system, f"{path}/{name}"):
                        system.move(f"{path}/{name}", f"{path}/_read/{name}")
        if end["entry"] > self._read_up_to():
            folders.replaced(system, f"{path}/_journal/read", str(end["entry"]).encode())
        for n in self._entries():
            if n < end["entry"]:
                system.delete_file(self._entry(n))


class Mailbox(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return RECORD

    def streamReader(self, schema) -> DataSourceStreamReader:
        most = self.options.get("filesPerPoll")
        return _Reader(self.options["path"], int(most) if most else None)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Mailbox)
