"""Files by way of Spark's own file systems: any path that Spark reads."""

from __future__ import annotations

import csv
import io

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if there is no such folder."""
    _, at, system = _opened(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(at)) if system.exists(at) else []


def matches(spark: SparkSession, pattern: str) -> bool:
    """Whether any file has this path or fits this pattern."""
    _, at, system = _opened(spark, pattern)
    return bool(system.globStatus(at))


def lengths(spark: SparkSession, pattern: str) -> list[tuple[str, int]]:
    """(path, length) of the files that have this path or fit this pattern."""
    _, at, system = _opened(spark, pattern)
    return [(s.getPath().toString(), s.getLen()) for s in system.globStatus(at) or [] if s.isFile()]


def remove(spark: SparkSession, path: str) -> None:
    _, at, system = _opened(spark, path)
    system.delete(at, True)


def header(columns: list[str]) -> bytes:
    out = io.StringIO()
    csv.writer(out, lineterminator="\n").writerow(columns)
    return out.getvalue().encode()


def join_files(spark: SparkSession, folder: str, path: str, head: bytes = b"") -> None:
    """One file out of a folder's part files, in the order of their names, behind ``head``: copied as streams between file
    systems, whatever their size, and renamed when whole. An earlier file of that name is replaced."""
    jvm, at, system = _opened(spark, path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    made = at.suffix(".joining")
    out = system.create(made, True)
    try:
        out.write(bytearray(head))
        for name in names(spark, folder):
            if not name.startswith(("_", ".")):
                part = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
                data = part.getFileSystem(conf).open(part)
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(data, out, conf, False)
                data.close()
    finally:
        out.close()
    system.delete(at, False)
    system.rename(made, at)
