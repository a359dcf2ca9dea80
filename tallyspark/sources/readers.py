"""Readers. Captured API responses are JSON files; live connectors write such files and are outside the engine."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark import schemas
from tallyspark.operators import actions, metrics, predicates
from tallyspark.sources import folders, hadoop



def task_pages(spark: SparkSession, path: str, on_error: str = "raise", limit: int | None = None, missing: str = "empty", multi_line: bool = True) -> DataFrame:
    """Pages (id, properties) of response files with a ``results`` list.

    ``on_error``: ``raise`` stops at a malformed file (E2), ``empty`` reads it as no pages (E3). ``missing``: a response without
    ``results`` has no pages (``empty``, S3a) or stops the job (``raise``, S3b and S3c). With ``limit``, the first pages by id (L2).
    Files hold one response, or, without ``multi_line``, one in each line."""
    if on_error not in ("raise", "empty") or missing not in ("raise", "empty"):
        raise ValueError("on_error and missing are raise or empty")
    reader = spark.read.schema(schemas.PAGES).option("multiLine", multi_line).option("mode", "FAILFAST" if on_error == "raise" else "PERMISSIVE")
    results = F.col("results")
    if missing == "raise":
        results = F.when(results.isNotNull(), results).otherwise(F.raise_error(F.lit("a response has no results")))
    pages = reader.json(path).select(F.explode(results).alias("page")).select("page.*")
    return pages if limit is None else pages.orderBy("id").limit(limit)


def database_schema(spark: SparkSession, path: str) -> DataFrame:
    """(property, type, option) of a database description, an option a row, null for kinds without."""
    kind = "properties MAP<STRING, STRUCT<type: STRING, `select`: STRUCT<options: ARRAY<STRUCT<name: STRING>>>>>"
    props = spark.read.schema(kind).option("multiLine", True).json(path).select(F.explode("properties").alias("property", "of"))
    options = F.when(F.col("of.type") == "select", F.col("of.select.options.name"))
    return props.select("property", F.col("of.type").alias("type"), F.explode_outer(options).alias("option"))


def csv_table(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """A CSV with a header and doubled quotes; text is read as it stands, blanks and the word None included."""
    reader = spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", multi_line)
    return reader.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("mode", "FAILFAST").csv(path)


def latest_message(messages: DataFrame, sender: str | None = None, recipient: str | None = None) -> DataFrame:
    """The newest unread message, then the greatest id."""
    return metrics.latest(predicates.mailbox(messages, sender, recipient), "received", "id")


def attachments(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of whole files, for a path or a pattern; none if there is no such file (S9). No other file is listed."""
    if not hadoop.matches(spark, path):
        return spark.createDataFrame([], "path string, length long, content binary")
    return spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(path).select("path", "length", "content")


def attachment_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of files of any length, for a path or a pattern, unread, empty ones too; none if there is no such file."""
    return spark.createDataFrame(hadoop.lengths(spark, path), "path string, length long")


def with_part_contents(rows: DataFrame, size: int = actions.PART_BYTES) -> DataFrame:
    """Rows of ``actions.with_attachment_parts`` with each part's bytes (``content``), which tasks read one part at a time; null
    where there is no file. Paths are ones that pyarrow has a file system for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row, data = batch.slice(k, 1), None
                if (path := row["file"][0].as_py()) is not None:
                    system, at = folders.opened(path)
                    with system.open_input_file(at) as file:
                        data = file.read_at(size, row["part"][0].as_py() * size)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], [*row.schema.names, "content"])

    fields = T.StructType([*rows.schema.fields, T.StructField("content", T.BinaryType())])
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, "file", "part").mapInArrow(run, fields)
