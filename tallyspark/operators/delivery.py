"""What became of intended effects: delivery reports of connectors joined to the outbox.

A connector makes one report for each attempt: (key, at, code, error). ``attempts`` runs a connector over effects; what it
does with them is its own business, and nothing else here sends anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the response code that counts as success.
SUCCESS = 200
PENDING, SENT, FAILED = "pending", "sent", "failed"


def succeeded(code: Column, error: Column | None = None) -> Column:
    """Whether an attempt went through: the code says so and there is no error (F16); never null."""
    fine = F.coalesce(code == SUCCESS, F.lit(False))
    return fine if error is None else fine & error.isNull()


def delivery_status(outbox: DataFrame, reports: DataFrame) -> DataFrame:
    """The outbox with ``state``, ``attempts`` and the last failed attempt's ``error``.

    An effect with a successful attempt is sent, whatever failed before or after; one with failures only is failed;
    one without reports is pending. Reports of keys that the outbox does not have are left out. A failure without a text
    is shown by its code."""
    fine = succeeded(F.col("code"), F.col("error"))
    why = F.coalesce("error", F.concat(F.lit("code "), F.col("code").cast("string")), F.lit("no response"))
    told = reports.groupBy("key").agg(F.count(F.lit(1)).alias("attempts"), F.max(fine).alias("fine"), F.max(F.when(~fine, F.struct("at", why.alias("why")))).alias("last"))
    state = F.when(F.col("fine"), F.lit(SENT)).when(F.col("attempts") > 0, F.lit(FAILED)).otherwise(F.lit(PENDING))
    return outbox.join(told, "key", "left").select(*outbox.columns, state.alias("state"), F.coalesce("attempts", F.lit(0)).alias("attempts"), F.col("last.why").alias("error"))


def attempts(due: DataFrame, connector: Callable[[dict], tuple[int | None, str | None]], at: Column) -> DataFrame:
    """Reports of one attempt for each effect: ``connector`` takes an effect (a row of ``due`` as a dict) and gives the response's
    code and error. What it raises is that effect's error and no other's (E4, 3.2); the job goes on.

    A task that is run again attempts its effects again, so a connector should hand on ``key`` as what makes a request the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = []
            for row in batch.to_pylist():
                try:
                    code, error = connector(row)
                except Exception as failure:
                    code, error = None, f"{type(failure).__name__}: {failure}"
                told.append((row["key"], code, error))
            yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.string()))], ["key", "code", "error"])

    made = due.mapInArrow(run, "key string, code int, error string")
    return made.select("key", at.cast("timestamp_ntz").alias("at"), "code", "error")


def dead_letters(status: DataFrame, *channels: str) -> DataFrame:
    """(task_id, error) of failed effects, of some channels only if given, with what should have been sent."""
    # The words "error" and "Message" in a dead letter's text.
    failed = status.filter(F.col("state") == FAILED)
    if channels:
        failed = failed.filter(F.col("channel").isin(*channels))
    return failed.select(F.col("key").alias("task_id"), F.concat_ws(" | ", F.concat(F.col("channel"), F.lit(" error: "), F.col("error")), F.concat(F.lit("Message: "), F.col("payload"))).alias("error"))


def due_again(status: DataFrame, most: int = 3) -> DataFrame:
    """The effects to try again: pending ones, and failed ones with fewer than ``most`` attempts."""
    return status.filter((F.col("state") == PENDING) | ((F.col("state") == FAILED) & (F.col("attempts") < most)))
