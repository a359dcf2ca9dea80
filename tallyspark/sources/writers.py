"""Writers: history tables, CSV exports, dead letters, outboxes."""

from __future__ import annotations

import datetime
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark import schemas
from tallyspark.sources import committed, folders, hadoop


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; a local session that names none gets a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared}/{name}-{uuid.uuid4().hex}"


def append_history(rows: DataFrame, path: str, day: str = "Date") -> None:
    """Append to a history table, partitioned by day (K1, K2, U1). Long and wide rows have tables of their own."""
    rows.write.mode("append").partitionBy(day).parquet(path)


def export_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header in each part, quotes doubled, blanks kept (K3)."""
    options = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.write.mode(mode).options(**options).csv(path)


def export_csv_file(rows: DataFrame, path: str, *order: str) -> None:
    """One CSV file with one header, in the given order (K3), such as an attachment: a range sort writes ordered parts, whose
    bytes are then joined as streams. No task and no memory holds them all."""
    parts = f"{path}.parts-{uuid.uuid4().hex}"
    options = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    ordered = rows.orderBy(*order).drop(*(c for c in order if c.startswith("_"))) if order else rows
    ordered.write.options(**options).csv(parts)
    hadoop.join_files(rows.sparkSession, parts, path, hadoop.header(ordered.columns))
    hadoop.remove(rows.sparkSession, parts)


def write_errors(errors: DataFrame, path: str) -> bool:
    """Dead letters (task_id, error); without any, nothing is written (K4, F15). They are counted as they are written."""
    seen = Observation()
    export_csv(errors.observe(seen, F.count(F.lit(1)).alias("n")), path)
    if seen.get.get("n"):
        return True
    hadoop.remove(errors.sparkSession, path)
    return False


def write_split(rows: DataFrame, path: str) -> dict[str, int]:
    """Write rows with ``error`` as a table with the folders ``kind=good`` and ``kind=bad``, in one job that counts both."""
    seen, bad = Observation(), F.col("error").isNotNull()
    counted = rows.withColumn("kind", F.when(bad, "bad").otherwise("good")).observe(seen, F.count_if(~bad).alias("good"), F.count_if(bad).alias("bad"))
    counted.write.partitionBy("kind").parquet(path)
    return {"good": seen.get.get("good", 0), "bad": seen.get.get("bad", 0)}


def write_digest(lines: DataFrame, path: str, order: str = "id") -> None:
    """The lines of a digest as text files, whose names follow the order of the lines."""
    lines.orderBy("section", F.col(order).asc_nulls_first()).select("line").write.mode("overwrite").text(path)


EFFECT, REPORT = "effect", "report"


def _entries(rows: DataFrame, kind: str) -> DataFrame:
    """Rows in the columns of the ledger; what they don't have is null."""
    fields = [f for f in T.StructType.fromDDL(schemas.LEDGER) if f.name not in ("commit", "kind", "month")]
    own = {c.lower() for c in rows.columns}
    columns = ((F.col(f.name) if f.name.lower() in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields)
    return rows.select(*columns, F.lit(kind).alias("kind")).withColumn("month", F.trunc("day", "month"))


def _on_days(first: datetime.date | None, last: datetime.date | None, null: bool) -> Column:
    """Days from first to last, and null ones if asked for; the months prune folders."""
    month = F.col("month").between(F.trunc(F.lit(first).cast("date"), "month"), F.trunc(F.lit(last).cast("date"), "month"))
    return (month & F.col("day").between(F.lit(first), F.lit(last))) | (F.col("month").isNull() & F.lit(null))


def ledger(spark: SparkSession, path: str, kind: str, days: tuple[datetime.date, datetime.date] | None = None) -> DataFrame:
    """The effects (``effect``) or attempt reports (``report``) of a ledger, committed writes only; of some days, first and last,
    if given, whose folders alone are read."""
    system, folder = folders.opened(path)
    system.create_dir(folder)  # there is a table before the first write, too
    rows = spark.read.schema(schemas.LEDGER).parquet(path).filter(F.col("kind") == kind)
    rows = rows if days is None else rows.filter(_on_days(*days, False))
    names = T.StructType.fromDDL(schemas.OUTBOX if kind == EFFECT else schemas.REPORT).names
    return rows.select(*names, "day")


def add_to_outbox(rows: DataFrame, path: str, reports: DataFrame | None = None, commit: str | None = None) -> None:
    """Add the outbox rows (with ``day``) whose keys aren't there yet, and the attempt reports (K5 to K10), in one
    transaction: all of them appear, or, if a task fails, none. A replay adds nothing, whatever its days.

    The ledger is divided by kind and month, null days included, and only the days of ``rows`` are looked up, as a replay has the
    days of the first run. A report is another one if its key, time, code or error is. A ``commit`` that is there already is left alone."""
    committed.register(rows.sparkSession)
    entries = [_known_apart(_entries(rows, EFFECT), path, EFFECT, ["key"])]
    if reports is not None:
        days = reports if "day" in reports.columns else reports.withColumn("day", F.col("at").cast("date"))
        entries.append(_known_apart(_entries(days, REPORT), path, REPORT, ["key", "at", "code", "error"]))
    # few files for each month; a large one is split among tasks
    new = reduce(DataFrame.unionByName, entries).hint("rebalance", "kind", "month").sortWithinPartitions("kind", "month", "day")
    options = {"path": path, "partitionBy": "kind,month"} | ({"commit": commit} if commit else {})
    new.write.format("committed").options(**options).mode("append").save()


def _known_apart(entries: DataFrame, path: str, kind: str, same: list[str]) -> DataFrame:
    """The entries, each once, that the ledger doesn't have on their days."""
    facts = [F.min("day"), F.max("day"), F.bool_or(F.col("day").isNull())]
    timed = [F.min("at"), F.max("at"), F.bool_or(F.col("at").isNull())] if "at" in same else []
    first, last, null, *times = entries.agg(*facts, *timed).first()
    system, folder = folders.opened(path)
    system.create_dir(folder)
    there = entries.sparkSession.read.schema(schemas.LEDGER).parquet(path).filter((F.col("kind") == kind) & _on_days(first, last, bool(null)))
    if times:  # an equal report has an equal time: the reports of other rounds are skipped as they are read
        begin, end, untimed = times
        there = there.filter(F.col("at").between(F.lit(begin), F.lit(end)) | (F.col("at").isNull() & F.lit(bool(untimed))))
    known = there.select(*(F.col(c).alias(f"_{c}") for c in same))
    equal = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same))
    return entries.dropDuplicates(same).join(known, equal, "left_anti")


def add_letters(bad: DataFrame, path: str, *place: str) -> None:
    """Add dead letters (task_id, error, raw) that aren't there yet, in one transaction. ``place`` are the columns that tell
    where a record stood; equal texts of one place are numbered, so each is a letter of its own and a replay adds none."""
    committed.register(bad.sparkSession)
    copy = F.row_number().over(Window.partitionBy("raw", *place).orderBy("task_id", "error"))
    parts = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("raw", *place, "_copy"))
    letters = bad.withColumn("_copy", copy).select(F.sha2(F.concat_ws("\x1f", *parts), 256).alias("key"), "task_id", "error", "raw")
    known = letters_in(bad.sparkSession, path).select("key")
    letters.join(known, "key", "left_anti").write.format("committed").option("path", path).mode("append").save()


def letters_in(spark: SparkSession, path: str) -> DataFrame:
    """(key, task_id, error, raw) of all dead letters."""
    system, folder = folders.opened(path)
    system.create_dir(folder)
    return spark.read.schema(f"{schemas.LETTER}, commit STRING").parquet(path).drop("commit")
