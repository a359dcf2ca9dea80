"""A table by key that is updated in place: rows lie in folders by a hash of their key, and an update rewrites those it touches.

An update's keys say which folders those are; only they are read, joined and replaced, and files of all others stay as
they are. The new folders are staged whole before any is replaced.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.operators import actions
from tallyspark.sources import hadoop

BUCKET = "bucket"


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int").alias(BUCKET)


def create(rows: DataFrame, path: str, key: str, buckets: int) -> None:
    """Write ``rows`` as such a table; about 128 MB a folder is right. Null keys share a folder."""
    rows.withColumn(BUCKET, _bucket(key, buckets)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, {BUCKET} int").parquet(path)


def update(spark: SparkSession, path: str, schema: str, updates: DataFrame, key: str, buckets: int) -> int:
    """Apply the non-null values of ``updates`` to the rows with their keys (K6a, K6b); returns how many folders it touched.

    Of several updates of a key, the largest values count; updates of keys that aren't there change nothing, and those without
    a key are left out."""
    placed = updates.filter(F.col(key).isNotNull()).withColumn(BUCKET, _bucket(key, buckets))
    touched = [r[0] for r in placed.select(BUCKET).distinct().collect()]  # as many as folders, at most
    if not touched:
        return 0
    old = read(spark, path, schema).filter(F.col(BUCKET).isin(touched))
    new = actions.keyed_update(old, placed.drop(BUCKET), key)
    staged = f"{path.rstrip('/')}.update-{uuid.uuid4().hex}"
    new.write.partitionBy(BUCKET).parquet(staged)
    whole = spark.read.schema(T.StructType([*T.StructType.fromDDL(schema), T.StructField(BUCKET, T.IntegerType())])).parquet(staged)
    whole.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(path)
    hadoop.remove(spark, staged)
    return len(touched)
