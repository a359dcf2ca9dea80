"""A transactional sink: a write shows all its rows at once or none.

Tasks write Parquet files below ``_staging``. The driver's commit gathers the files of the tasks that succeeded, those of
failed and repeated attempts left out, and renames their folder to ``commit=<id>``: one rename, so effects, reports and
whatever else a write holds appear together. An abort removes them; what tasks that still ran then leave below ``_staging`` is
never read, and a commit ``STALE`` later removes it. A write whose commit is there already adds
nothing, so a replayed batch is harmless. The file system must rename folders in one step, as local ones and HDFS do.

``df.write.format("committed").option("path", folder).option("commit", name).option("partitionBy", "kind,day").mode("append")``;
as a streaming sink, the batch number is added to the name. Readers use ``spark.read.schema(...).parquet(folder)``; partition
columns (text, dates, integers) are folders, null ones too.
"""

from __future__ import annotations

import datetime
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage

from . import folders

#: Files that a task has open at once.
OPEN_FILES = 16
#: Age from which files of writes that were neither committed nor aborted are removed.
STALE = datetime.timedelta(days=2)
NULL = "__HIVE_DEFAULT_PARTITION__"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _folder(names: list[str], values: tuple) -> str:
    plain = lambda v: "".join(c if c.isalnum() or c in " -_." or ord(c) > 127 else f"%{ord(c):02X}" for c in str(v))  # noqa: E731  as Spark names folders
    return "".join(f"{n}={NULL if v is None else plain(v)}/" for n, v in zip(names, values, strict=True))


class _Writer:
    def __init__(self, options):
        self.path, self.name = options["path"], options.get("commit") or uuid.uuid4().hex
        self.keys = [k for k in options.get("partitionBy", "").split(",") if k]
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """Files of one task attempt, by partition; of more than ``OPEN_FILES`` partitions at once, the oldest file is closed."""
        system, path = folders.opened(self.path)
        own, files = f"_staging/{self.run}/{uuid.uuid4().hex}", []
        writers: OrderedDict[tuple, pq.ParquetWriter] = OrderedDict()
        try:
            for batch in iterator:
                table = pa.Table.from_batches([batch])
                for values in table.select(self.keys).group_by(self.keys).aggregate([]).to_pylist() if self.keys else [{}]:
                    part = table
                    for k, v in values.items():
                        part = part.filter(pc.is_null(part[k]) if v is None else pc.equal(part[k], pa.scalar(v, part[k].type)))
                    part, key = part.drop_columns(self.keys), tuple(values[k] for k in self.keys)
                    if not part.num_rows:
                        continue
                    if key not in writers:
                        if len(writers) == OPEN_FILES:
                            writers.popitem(last=False)[1].close()
                        folder = f"{own}/{_folder(self.keys, key)}".rstrip("/")
                        system.create_dir(f"{path}/{folder}")
                        files.append(f"{folder}/{uuid.uuid4().hex}.parquet")
                        writers[key] = pq.ParquetWriter(f"{path}/{files[-1]}", part.schema, filesystem=system, compression="zstd")
                    writers[key].write_table(part)
                    writers.move_to_end(key)
        finally:
            for w in writers.values():
                w.close()
        return Written(files)

    def _commit(self, messages: list[Written | None], name: str) -> None:
        system, path = folders.opened(self.path)
        final = f"{path}/commit={name}"
        if not folders.exists(system, final):
            whole = f"{path}/_staging/{self.run}.{name}"
            removed = len(f"_staging/{self.run}/") + 33  # the attempt's own folder
            system.create_dir(whole)
            for f in (f for m in messages if m for f in m.files):
                goal = f"{whole}/{f[removed:]}"
                system.create_dir(goal.rpartition("/")[0])
                system.move(f"{path}/{f}", goal)
            if any(m and m.files for m in messages):
                system.move(whole, final)
            else:
                folders.removed(system, whole)
        folders.removed(system, f"{path}/_staging/{self.run}")
        for f in folders.listed(system, f"{path}/_staging"):
            if f.mtime and f.mtime < datetime.datetime.now(datetime.timezone.utc) - STALE:
                folders.removed(system, f.path)

    def _abort(self) -> None:
        system, path = folders.opened(self.path)
        folders.removed(system, f"{path}/_staging/{self.run}")


class _BatchWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, self.name)

    def abort(self, messages: list[Written | None]) -> None:
        self._abort()


class _StreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._commit(messages, f"{self.name}-{batchId:012d}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._abort()


class Committed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "committed"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("committed writes only append")
        return _BatchWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamArrowWriter:
        return _StreamWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Committed)
