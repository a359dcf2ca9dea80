"""A history by day that is read once: the latest day from folder names, weekly counts from sums that are kept by day.

The history is partitioned by day. Beside it stands a table of sums, partitioned by the same days: appending a day replaces
that day's sums and no others, so neither alerts nor weekly counts read days that they have read before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.sources import hadoop


def days(spark: SparkSession, path: str, day: str) -> list[str]:
    """The days that a table partitioned by day has, from the names of its folders; the null day is left out."""
    found = (name.removeprefix(f"{day}=") for name in hadoop.names(spark, path) if name.startswith(f"{day}="))
    return sorted(d for d in found if d != "__HIVE_DEFAULT_PARTITION__")


def of_latest_day(spark: SparkSession, path: str, schema: str, day: str, cond: Column) -> DataFrame:
    """The rows of the latest day that fulfil ``cond`` (F1, A4): no other day is listed or read."""
    known = days(spark, path, day)
    rows = spark.read.schema(schema).parquet(path).filter(F.col(day) == F.lit(known[-1] if known else None).cast("date"))
    return rows.filter(F.coalesce(cond, F.lit(False)))


def append(rows: DataFrame, path: str, sums: str, day: str, status: str, schema: str) -> None:
    """Append rows to the history (K1) and count the touched days anew from their own partitions (A1)."""
    spark = rows.sparkSession
    rows.write.mode("append").partitionBy(day).parquet(path)
    touched = [r[0] for r in rows.select(day).distinct().collect()]  # a few days
    own = F.col(day).isin(touched)
    if None in touched:
        own = F.coalesce(own, F.lit(False)) | F.col(day).isNull()
    counts = spark.read.schema(schema).parquet(path).filter(own).groupBy(day, status).agg(F.count(F.lit(1)).alias("n"))
    counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(sums)


def weekly(spark: SparkSession, sums: str, day: str, status: str, values: tuple[str, ...]) -> DataFrame:
    """Counts by week and status, from the sums alone."""
    kept = spark.read.schema(f"`{status}` string, n long, `{day}` date").parquet(sums).filter(F.col(status).isNotNull())
    weeks = kept.withColumn("Week", F.date_trunc("week", F.col(day)).cast("date"))
    return weeks.groupBy("Week").pivot(status, list(values)).agg(F.sum("n")).na.fill(0)
