"""Helpers shared by the corpus operators: shared storage, text chunks, word and hash arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Text bytes that one step of a task holds as arrays; a longer document makes a step of its own.
CHUNK_BYTES = 4 << 20
BATCH_BYTES = 8 << 20

U64 = np.uint64
#: Stands for a null id.
LEAST_ID = -(1 << 63)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local session that names none gets a temporary one; a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def bound_batches(spark: SparkSession) -> None:
    """Let Arrow batches end at ``BATCH_BYTES``, too, where the session sets no bound: long texts make large rows."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "2147483647")) == 2147483647:
        spark.conf.set(key, str(BATCH_BYTES))


def stored_in(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables."""
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors.

    Results read such tables, so they stay until ``forget`` or whoever owns the shared folder removes them."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{stored_in(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application: once its results are written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(stored_in(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(name: str, df: DataFrame) -> str:
    """``name``, with underscores behind it until ``df`` has no such column (in whatever case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ranked(df: DataFrame, *order) -> DataFrame:
    """``df`` with ``rank`` from 0 in the given order: a range sort, then each part's offset, from one row for each part."""
    kept = store(df.orderBy(*order).withColumn("__part", F.spark_partition_id()).withColumn("__row", F.monotonically_increasing_id()), "ranked")
    parts = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("low"))
    before = F.sum("n").over(Window.orderBy("__part")) - F.col("n")
    shifts = parts.select("__part", (before - F.col("low")).alias("__shift"))
    return kept.join(F.broadcast(shifts), "__part").withColumn("rank", F.col("__row") + F.col("__shift")).drop("__part", "__row", "__shift")


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text of each holds about ``limit`` bytes at most, or is one row."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + limit, side="right")))
            yield batch.slice(at, end - at)
            at = end


def joined(chunks_in: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Join small batches of a task up to ``limit`` bytes of text, so that array steps aren't tiny."""
    held, size = [], 0
    for part in chunks(chunks_in, column, limit):
        n = pc.sum(pc.binary_length(part[column])).as_py() or 0
        if held and size + n > limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        if part.num_rows:
            held.append(part)
            size += n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column in a row and the offset of each text; null counts as empty."""
    col = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """The words of a text column: byte bounds in ``data`` and, for each text, its range of words."""

    def __init__(self, column: pa.Array | None = None, data: np.ndarray | None = None):
        """Of a string column, or of the bytes of one text."""
        data, offsets = text_bytes(column) if column is not None else (data, np.array([0, len(data)]))
        self.data = data
        solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
        first = solid.copy()
        first[1:] &= ~solid[:-1]
        last = solid.copy()
        last[:-1] &= ~solid[1:]
        inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
        first[inner] |= solid[inner]  # a word ends with its text, too
        last[inner - 1] |= solid[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.solid = solid

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        lens = self.ends - self.starts
        if not len(lens):
            return np.empty(0, U64)
        at = np.cumsum(lens) - lens
        powers = np.full(int(lens.max()), 0x9E3779B97F4A7C15, U64)
        powers[0] = 1
        powers = np.multiply.accumulate(powers)
        part = self.data[self.solid].astype(U64) + U64(1)
        part *= powers[np.arange(len(part)) - np.repeat(at, lens)]
        return mix(np.add.reduceat(part, at) + lens.astype(U64))

    def packed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words with one space after each, and their bounds there (without the space)."""
        lens = self.ends - self.starts
        starts = np.cumsum(lens + 1) - lens - 1
        out = np.full(int((lens + 1).sum()), 32, np.uint8)
        keep = np.ones(len(out), bool)
        keep[starts + lens] = False
        out[keep] = self.data[self.solid]
        return out, starts, starts + lens


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive values (by doubling); shorter than ``h`` by n - 1."""
    base = 0xD6E8FEB86659FD93
    out, have, done = None, h, 1
    got = 0
    while True:
        if n & done:
            if out is None:
                out, got = have, done
            else:
                m = len(h) - got - done + 1
                out = out[:m] * U64(pow(base, done, 1 << 64)) + have[got : got + m] if m > 0 else np.empty(0, U64)
                got += done
        if got == n:
            return mix(out) if len(out) else np.empty(0, U64)
        m = max(len(have) - done, 0)
        have = have[:m] * U64(pow(base, done, 1 << 64)) + have[done : done + m]
        done *= 2


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    """The least value of each ``width`` consecutive ones."""
    if len(keys) < width:
        return keys[:0]
    done = 1
    while done * 2 <= width:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    rest = width - done
    return np.minimum(keys[: len(keys) - rest], keys[rest:]) if rest else keys
