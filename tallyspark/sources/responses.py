"""Captured query responses as a source: a partition for each response, or, of more than ``PARTITIONS``, for several; filters by page
id and last edit are pushed into it.

``spark.read.format("responses").option("path", folder)``. A response is a JSON file with a ``results`` list. Options:
``onError`` (``raise``, or ``empty``: a response that isn't JSON has no pages), ``missing`` (``empty``, or ``raise``: a response
without ``results`` stops the job) and ``limit`` (pages of a response at most, as a page size). Rows are (response, id, edited,
page): the file, the page's id and time of its last edit, and the page as JSON text, so that a filter pushed down keeps
pages from being written out and parsed again.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from . import folders

SCHEMA = "response STRING, id STRING, edited STRING, page STRING"
_TESTS = {EqualTo: lambda x, y: x == y, GreaterThan: lambda x, y: x > y, GreaterThanOrEqual: lambda x, y: x >= y, LessThan: lambda x, y: x < y, LessThanOrEqual: lambda x, y: x <= y, In: lambda x, y: x in y}


#: Responses up to which each has a partition of its own, and the bytes from which a partition takes no more of them.
PARTITIONS, PARTITION_BYTES = 256, 16 << 20
#: Rows of a batch that is handed to Spark.
BATCH = 4096


@dataclass
class Group(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.limit = options["path"], int(options["limit"]) if options.get("limit") else None
        self.on_error, self.missing = options.get("onError", "raise"), options.get("missing", "empty")
        if self.on_error not in ("raise", "empty") or self.missing not in ("raise", "empty"):
            raise ValueError("onError and missing are raise or empty")
        self.pushed: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if (type(f) in _TESTS or isinstance(f, IsNotNull)) and f.attribute in (("response",), ("id",), ("edited",)):
                self.pushed.append(f)
            else:
                yield f

    def _wanted(self, row: dict) -> bool:
        for f in self.pushed:
            x = row.get(f.attribute[0])
            if x is None or type(f) in _TESTS and not _TESTS[type(f)](x, f.value):
                return False
        return True

    def partitions(self) -> Sequence[InputPartition]:
        system, path = folders.opened(self.path)
        files = [f for f in folders.listed(system, path) if f.type == fs.FileType.File and not f.base_name.startswith((".", "_"))]
        own = [f for f in self.pushed if f.attribute == ("response",)]
        kept = [f for f in files if all(isinstance(p, IsNotNull) or _TESTS[type(p)](f.base_name, p.value) for p in own)]
        most, out, size = -(-len(kept) // PARTITIONS), [], 0
        for f in kept:
            if not out or len(out[-1].paths) == most or size >= PARTITION_BYTES:
                out.append(Group([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size or 0
        return out

    def _pages(self, paths: list[str]) -> Iterator[tuple]:
        for path in paths:
            system, _ = folders.opened(self.path)
            try:
                found = json.loads(folders.content(system, path))
            except ValueError:
                if self.on_error == "raise":
                    raise ValueError(f"a response isn't JSON: {path}") from None
                continue
            pages = found.get("results") if isinstance(found, dict) else None
            if pages is None and self.missing == "raise":
                raise ValueError(f"a response has no results: {path}")
            name = path.rpartition("/")[2]
            for page in (pages or [])[: self.limit]:
                row = {"response": name, "id": page.get("id"), "edited": page.get("last_edited_time")}
                if self._wanted(row):
                    yield name, row["id"], row["edited"], json.dumps(page, ensure_ascii=False)

    def read(self, partition: Group | None) -> Iterator[pa.RecordBatch]:
        rows = self._pages(partition.paths if partition else [])  # an empty folder has none
        while some := list(islice(rows, BATCH)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*some, strict=True)], ["response", "id", "edited", "page"])


class Responses(DataSource):
    @classmethod
    def name(cls) -> str:
        return "responses"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Responses)
