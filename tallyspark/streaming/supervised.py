"""A supervised poll: a stream that fails is started again, a bounded number of times, and every attempt leaves a report.

Reports are those of deliveries (key, at, code, error): a failed attempt has the failure's text, one that ends or gets on has
the code of success. So the state of a poll, its attempts and its last failure come out of ``delivery.delivery_status``.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from tallyspark import schemas
from tallyspark.operators import delivery
from tallyspark.sources import writers

FAILURE = 500


def key(name: str) -> str:
    """The key of a poll's effect and reports."""
    return f"poll:{name}"


def effect(spark: SparkSession, name: str):
    """The poll as a row of the outbox, which its reports belong to."""
    return spark.range(1).select(F.lit(key(name)).alias("key"), F.lit("poll").alias("channel"), F.lit(name).alias("target"), F.lit("").alias("payload"))


class Progress(StreamingQueryListener):
    """Batches that have ended, by query id; a batch without rows counts as well."""

    def __init__(self) -> None:
        self.batches: dict[str, int] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.batches.setdefault(str(event.id), -1)

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        self.batches[str(p.id)] = max(self.batches.get(str(p.id), -1), p.batchId)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def supervise(spark: SparkSession, name: str, start: Callable[[], StreamingQuery], ledger: str, most: int = 3, clock: Callable[[], datetime.datetime] = datetime.datetime.now) -> int:
    """Run a query until it ends by itself; after a failure, start it again (T1, E4). Returns the attempts.

    ``start`` starts the query from its checkpoint. After ``most`` failures in a row without a batch done between them, the last
    failure is raised. Every attempt adds its report to the ledger, whose ``at`` is by ``clock``."""
    progress, failures, attempts, done = Progress(), 0, 0, {}
    spark.streams.addListener(progress)

    def report(code: int, error: str | None) -> None:
        row = [(key(name), clock(), code, error)]
        writers.add_to_outbox(effect(spark, name).withColumn("day", F.lit(None).cast("date")), ledger, spark.createDataFrame(row, schemas.REPORT))

    try:
        while True:
            attempts += 1
            try:
                query = start()
                query.awaitTermination()
                report(delivery.SUCCESS, None)
                return attempts
            except StreamingQueryException as failure:
                report(FAILURE, str(failure).partition("\n")[0])
                moved = progress.batches.get(str(query.id), -1) > done.get(str(query.id), -1)
                done = dict(progress.batches)
                failures = 1 if moved else failures + 1
                if failures >= most:
                    raise
    finally:
        spark.streams.removeListener(progress)
