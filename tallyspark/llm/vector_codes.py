"""Vector codes: product quantisation in integers, nearest entries by VA-file filtering.

Components become integers, vectors are cut into ``PARTS`` equal parts, and each part position has a codebook of ``ENTRIES``
entries. A round assigns every part to its nearest entry and replaces each entry by the mean of its parts, rounded down.

Nearest entries: an approximation file keeps for every entry coordinate only its cell, ``BITS`` bits, between marks that
part the coordinates of the codebook evenly. For a query part, two tables give the least and the largest squared difference
that its coordinate can have from each cell; summed over the coordinates of an entry's cells they are bounds of its
distance. An entry whose lower bound is above the least upper bound can't be nearest; only the others are looked up and
measured in 64-bit integers. The sums are products of the tables with a 0/1 matrix of the entries' cells, in single
precision: their terms aren't negative, so a sum of n of them is off by (n + 1) * 2^-24 of itself at most, and the
comparison leaves more room than that.

Spark holds the vectors. A task hands on a round's sums and counts for each entry, so a shuffle carries 1,024 rows from each task,
whatever its vectors; the codebooks are a bounded table that driver and tasks hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, store, table

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bits of a coordinate's cell, and vectors that are measured side by side.
BITS, STEP = 4, 512
#: Integers from this size on make an error: squared distances of parts of 256 components stay below 2^62.
LARGEST = 1 << 26
#: Labels up to which their sums are broadcast; more meet their rows in ``SALTS`` parts of each label.
FEW_LABELS, SALTS = 100_000, 32


class Codebook:
    """The entries of one part position, with their approximation file."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n, dim = entries.shape
        if not n:  # of an empty table, which has no vector to code either
            return
        cells = 1 << BITS
        # marks between cells: cell c of a coordinate holds the values from low[c] to high[c], those that its entries take
        marks = np.quantile(entries, np.arange(1, cells) / cells, axis=0, method="lower")
        cell = (entries[None, :, :] > marks[:, None, :]).sum(0)
        self.low, self.high = np.zeros((dim, cells), np.int64), np.zeros((dim, cells), np.int64)
        self.onehot = np.zeros((dim * cells, n), np.float32)
        self.room = np.float32(1 + 4 * (dim + 2) / (1 << 24))
        for d in range(dim):
            for c in np.unique(cell[:, d]):
                inside = entries[cell[:, d] == c, d]
                self.low[d, c], self.high[d, c] = inside.min(), inside.max()
            self.onehot[d * cells + cell[:, d], np.arange(n)] = 1

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each query's nearest entry, ties to the lower index, and its squared distance."""
        found, far = np.empty(len(queries), np.int64), np.empty(len(queries), np.int64)
        for at in range(0, len(queries), STEP):
            q = queries[at : at + STEP]
            below, above = self.low - q[:, :, None], q[:, :, None] - self.high
            least = np.maximum(np.maximum(below, above), 0)
            most = np.maximum(-below, -above)
            lower = (least * least).reshape(len(q), -1).astype(np.float32) @ self.onehot
            upper = (most * most).reshape(len(q), -1).astype(np.float32) @ self.onehot
            row, entry = np.nonzero(lower <= (upper.min(1) * self.room)[:, None])
            apart = q[row] - self.entries[entry]
            distance = np.einsum("ij,ij->i", apart, apart)
            order = np.lexsort((entry, distance, row))
            first = order[np.flatnonzero(np.r_[True, np.diff(row[order]) != 0])]
            found[at : at + STEP], far[at : at + STEP] = entry[first], distance[first]
        return found, far


def _integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The integers of each vector as a binary of 32-bit integers, and its length; null and non-finite vectors go."""
    for batch in batches:
        vec = batch["vec"].cast(pa.list_(pa.float64()))
        values = np.asarray(vec.values.fill_null(np.nan) if vec.values.null_count else vec.values)
        start, out, size = vec.offsets.to_numpy(), [], []
        ok = np.isfinite(values)
        before = np.r_[0, np.cumsum(~ok)]
        valid = vec.is_valid().to_numpy(zero_copy_only=False) & (before[start[1:]] == before[start[:-1]])
        inside = np.abs(values) < LARGEST / SCALE
        for k in np.flatnonzero(valid).tolist():
            cut = slice(start[k], start[k + 1])
            if not inside[cut].all():
                raise ValueError(f"vectors have components of {LARGEST // SCALE} or more")
            out.append(np.floor(values[cut] * SCALE).astype(np.int32).tobytes())
            size.append(int(start[k + 1] - start[k]))
        kept = batch.filter(pa.array(valid))
        cols = [kept[c] for c in batch.schema.names if c != "vec"]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(size, pa.int32()), pa.array(out, pa.binary())], [*(c for c in batch.schema.names if c != "vec"), "dim", "code"])


def _parts(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as (vector, part, component)."""
    column = batch["code"]
    data = np.frombuffer(b"".join(column.to_pylist()), np.int32)
    return data.reshape(batch.num_rows, PARTS, -1).astype(np.int64)


def _sums(books: list[np.ndarray]):
    """For each part and entry, how many parts of a task's vectors have it as their nearest, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books]
        count, total = np.zeros((PARTS, len(books[0])), np.int64), np.zeros((PARTS, *books[0].shape), np.int64)
        for batch in batches:
            if batch.num_rows:
                parts = _parts(batch)
                for p in range(PARTS):
                    near = made[p].nearest(parts[:, p])[0]
                    order = np.argsort(near, kind="stable")
                    first = np.flatnonzero(np.r_[True, np.diff(near[order]) != 0])
                    total[p, near[order[first]]] += np.add.reduceat(parts[order, p], first, axis=0)
                    count[p] += np.bincount(near, minlength=len(books[0]))
        part, entry = np.nonzero(count)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(total[part, entry].ravel()), total.shape[2]).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(entry), pa.array(count[part, entry]), sums], ["part", "entry", "n", "sums"])

    return run


def fit(vectors: DataFrame, dim: int, id_col: str, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks after all rounds; ``vectors`` has the vectors' integers as ``code``, all of ``dim`` components."""
    # the table's rows in order of id and integers: Spark keeps the first ones of each task only
    first = vectors.orderBy(F.col(id_col).asc_nulls_last(), "code").select("code").limit(entries).collect()
    start = np.array([np.frombuffer(r["code"], np.int32) for r in first], np.int64).reshape(len(first), PARTS, dim // PARTS)
    books = [start[:, p].copy() for p in range(PARTS)]
    for _ in range(rounds):
        found = vectors.select("code").mapInArrow(_sums(books), "part long, entry long, n long, sums array<long>")
        added = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dim // PARTS)]
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*added).alias("sums")).collect():  # a row for each entry
            books[r["part"]][r["entry"]] = np.array([s // r["n"] for s in r["sums"]], np.int64)
    return books


def codebook_digest(books: list[np.ndarray]) -> str:
    """Digest of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def assign(vectors: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vectors`` with the codes of their nearest entries in place of their integers, and the squared distances summed over parts. Map-only."""
    error = free_name("error", vectors)
    others = [f for f in vectors.schema.fields if f.name not in ("code", "dim")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = [Codebook(b) for b in books]
        for batch in batches:
            far = np.zeros(batch.num_rows, np.int64)
            codes = np.zeros((batch.num_rows, PARTS), np.uint8)
            if batch.num_rows:
                parts = _parts(batch)
                for p in range(PARTS):
                    codes[:, p], own = made[p].nearest(parts[:, p])
                    far += own
            text = codes.tobytes().hex()
            code = [text[k : k + 2 * PARTS] for k in range(0, len(text), 2 * PARTS)]
            yield pa.RecordBatch.from_arrays([*(batch[f.name] for f in others), pa.array(code, pa.string()), pa.array(far)], [*(f.name for f in others), "code", error])

    return vectors.drop("dim").mapInArrow(run, T.StructType([*others, T.StructField("code", T.StringType()), T.StructField(error, T.LongType())]))


def _by_label(coded: DataFrame) -> DataFrame:
    """``coded`` with label_error: error summed over equal labels, nulls together. A label may hold any share of the rows."""
    sums = store(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels").withColumnRenamed("label", "of")
    same = coded["label"].eqNullSafe(sums["of"])
    if sums.count() <= FEW_LABELS:
        return coded.join(F.broadcast(sums), same).drop("of")
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS))
    sums = sums.withColumn("own", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    salted = coded.withColumn("salt", salt)
    return salted.join(sums, same & (salted["salt"] == sums["own"])).drop("of", "own", "salt")


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) of every vector that can be coded.

    Null vectors and those with null or non-finite components go; so do empty ones, and those whose length isn't the most
    usual one (the larger of several) or can't be cut into ``PARTS``. Ids may be null (behind all others) or repeat: rows are coded each,
    equal ids in order of their integers. With fewer rows than ``ENTRIES`` a codebook has an entry for each row. Components of
    65,536 and more raise an error. Other columns, whatever their names, are not read. An empty table gives an empty table.
    """
    src = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("vec"))
    kinds = [*src.drop("vec").schema.fields, T.StructField("dim", T.IntegerType()), T.StructField("code", T.BinaryType())]
    usable = store(src.mapInArrow(_integers, T.StructType(kinds)), "integers")
    usual = usable.filter(f"dim > 0 AND dim % {PARTS} = 0").groupBy("dim").count().orderBy(F.col("count").desc(), F.col("dim").desc()).first()
    dim = usual["dim"] if usual else PARTS
    usable = usable.filter(F.col("dim") == dim)
    books = fit(usable, dim, "vec_id")
    coded = store(assign(usable, books), "codes")
    out = _by_label(coded).withColumn("codebooks_sha256", F.lit(codebook_digest(books)))
    return out.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", "codebooks_sha256")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _op12_sql() -> str:
    """Rounds as tables: c<k> are the codebooks before round k, a<k> the nearest entries by them."""
    nearest = """a{k} AS MATERIALIZED (
    SELECT r, part, arg_min(entry, d * 1000 + entry) AS entry, min(d) AS d, any_value(v) AS v
    FROM (SELECT p.r, p.part, c.entry, p.v, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN c{k} c USING (part))
    GROUP BY r, part)"""
    moved = """m{k} AS (
    SELECT part, entry, list(s ORDER BY i) AS v
    FROM (SELECT part, entry, i, (floor_sum - ((floor_sum % n) + n) % n) // n AS s
          FROM (SELECT part, entry, i, sum(v[i])::BIGINT AS floor_sum, count(*) AS n FROM a{k}, unnest(range(1, 17)) AS u(i) WHERE i <= len(v) GROUP BY part, entry, i))
    GROUP BY part, entry),
c{n} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (part, entry))"""
    steps = [x for k in range(ROUNDS) for x in (nearest.format(k=k), moved.format(k=k, n=k + 1))]
    return f"""
WITH k AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v, row_number() OVER (ORDER BY vec_id) AS r
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * len(v) // {PARTS} + 1 : (part + 1) * len(v) // {PARTS}] AS v FROM k, range({PARTS}) AS u(part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, v FROM p WHERE r <= {ENTRIES}),
{", ".join(steps)},
{nearest.format(k=ROUNDS)},
o AS (SELECT r, string_agg(lower(lpad(to_hex(entry), 2, '0')), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{ROUNDS})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256
FROM o JOIN k USING (r) CROSS JOIN h
"""


OP12_SQL = _op12_sql()
