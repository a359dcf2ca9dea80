"""Near-duplicate vectors by int8 tile products with error bounds.

Every vector is scaled to length one and quantised to int8 with its own scale; the length of what
quantisation leaves over is its error. The product of two quantised vectors misses their cosine by
at most e1 * (1 + e2) + e2 * (1 + e1) + e1 * e2 (Cauchy-Schwarz), so pairs below the threshold by
more than that are settled by the tile product, and only the rest is computed in double precision.

Equal vectors are one node. Nodes are sorted by the signs of fixed projections and cut into blocks of
``BLOCK``, and ``SPAN`` blocks in a row are a region. Two regions are looked into only if their centres' angle allows a link
between any of their vectors, and so with blocks. Two blocks meet in a tile by their codes, scales and errors alone. Up to
``FEW`` pairs that may reach the threshold leave a tile as pairs, whose vectors are fetched; a tile with more, and a
block with itself, is computed with its vectors and hands on link counts and local components, never its pairs. The products of int8 codes run as single-precision matrix products over slices of ``SLICE``
components, in which their sums are exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ranked, store, table
from .components import components

BLOCK = 4096
SPAN = 64
STRIP = 1024
FEW = 4096
SLICE = 1024
SIGNS = 24


def _usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, digest, vec, signs) of the vectors that can link: finite, no null inside, not zero. Those of one length are taken together."""
    names = ["id", "digest", "vec", "signs"]
    for batch in batches:
        ids, column = batch["id"].to_numpy(), batch["vec"].cast(pa.list_(pa.float64()))
        sizes = np.where(column.is_valid().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()), 0)
        values = column.values.fill_null(np.nan).to_numpy(zero_copy_only=False)
        for dim in np.unique(sizes[sizes > 0]).tolist():
            rows = np.flatnonzero(sizes == dim)
            v = values[column.offsets.to_numpy()[rows][:, None] + np.arange(dim)] + 0.0  # no negative zero
            top = np.abs(v).max(1)
            fine = np.isfinite(top) & (top > 0)
            rows, v, top = rows[fine], v[fine], top[fine]
            bits = (v / top[:, None]) @ np.random.Generator(np.random.PCG64(dim)).standard_normal((SIGNS, dim)).T > 0
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in v]
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dim), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(ids[rows]), pa.array(digests, pa.binary()), flat, pa.array((bits << np.arange(SIGNS)).sum(1).astype(np.int32))], names)


def quantise(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows, their int8 codes, scales and error lengths (rounded up)."""
    v = v / np.abs(v).max(1, keepdims=True)
    unit = v / np.sqrt((v * v).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.sqrt(((unit - scale[:, None] * code) ** 2).sum(1)) * (1 + 1e-9) + 1e-12
    return unit, code, scale, error


def _centre(unit: np.ndarray) -> np.ndarray:
    """The direction of the mean of unit rows."""
    centre = unit.mean(0)
    length = np.sqrt(centre @ centre)
    return centre / length if length > 1e-9 else np.eye(1, unit.shape[1])[0]


def _pack(group: pa.Table) -> pa.Table:
    """One row for a block: ids, copies, raw and quantised vectors as binaries, centre and reach."""
    dim = group["dim"][0].as_py()
    raw = group["vec"].combine_chunks().flatten().to_numpy().reshape(-1, dim)
    unit, code, scale, error = quantise(raw)
    centre = _centre(unit)
    reach = float(np.arccos(np.clip((unit @ centre).min(), -1, 1))) + 1e-6
    data = [group["node"].to_numpy().astype("<i8"), group["copies"].to_numpy().astype("<i8"), raw, code, scale, error]
    return pa.table({"dim": pa.array([dim], pa.int32()), "block": group["block"][:1], "centre": pa.array([centre], pa.list_(pa.float64())), "reach": [reach], **{n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("ids", "times", "raw", "code", "scale", "error"), data, strict=True)}})


def _region(blocks: pd.DataFrame) -> pd.DataFrame:
    """One row for a region: its centre, and an angle within which all its vectors lie."""
    units = np.array(blocks["centre"].tolist())
    centre = _centre(units)
    reach = float((np.arccos(np.clip(units @ centre, -1, 1)) + blocks["reach"].to_numpy()).max()) + 1e-6
    return pd.DataFrame({"dim": blocks["dim"][:1], "region": blocks["region"][:1], "centre": [centre], "reach": [reach]})


class _Block:
    def __init__(self, row: dict, side: str, dim: int):
        of = lambda name, kind: np.frombuffer(row[side + name], kind)
        self.ids, self.times = of("ids", "<i8"), of("times", "<i8")
        self.code = of("code", np.int8).reshape(-1, dim).astype(np.float32)
        self.raw = of("raw", np.float64).reshape(-1, dim) if side + "raw" in row else None
        self.scale, self.error = of("scale", np.float64), of("error", np.float64)


def _near(left: _Block, right: _Block, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in left, in right) of all pairs that may reach the threshold; in one block, i < j."""
    dim = left.code.shape[1]
    for at in range(0, len(left.ids), STRIP):
        rows = slice(at, at + STRIP)
        dots = np.zeros((len(left.ids[rows]), len(right.ids)), np.float32 if dim <= SLICE else np.float64)
        for d in range(0, dim, SLICE):
            dots += left.code[rows, d : d + SLICE] @ right.code[:, d : d + SLICE].T
        # s1 * s2 * dot >= t - (e1 + e2 + 3 e1 e2); 1e-5 covers single precision
        low = np.float32(threshold - 1e-5) - (left.error[rows, None] * (1 + 3 * right.error[None, :]) + right.error[None, :]).astype(np.float32)
        dots *= left.scale[rows, None].astype(np.float32)
        dots *= right.scale[None, :].astype(np.float32)
        i, j = np.nonzero(dots >= low)
        i += at
        yield (i[i < j], j[i < j]) if same else (i, j)


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    return (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))


def _tile(left: _Block, right: _Block, same: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs with a cosine of ``threshold`` or more, in double precision."""
    found_i, found_j = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for i, j in _near(left, right, same, threshold):
        for part in range(0, len(i), 1 << 16):
            a, b = i[part : part + (1 << 16)], j[part : part + (1 << 16)]
            cos = _cosine(left.raw[a], right.raw[b])
            found_i.append(a[cos >= threshold])
            found_j.append(b[cos >= threshold])
    return np.concatenate(found_i), np.concatenate(found_j)


def _linked(ids: np.ndarray, times: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes with links among ``ids``, the vectors that each links with, and the least node of its local component."""
    links = np.bincount(i, weights=times[j], minlength=len(ids)) + np.bincount(j, weights=times[i], minlength=len(ids))
    root = ids.copy()
    while True:
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
        if (root == before).all():
            break
    some = np.flatnonzero(links)
    return ids[some], links[some].astype(np.int64), root[some]


def _apart(threshold: float) -> Column:
    """Whether vectors within ``reach`` of ``centre`` and within ``r`` of ``c`` are too far apart for a link."""
    dot = F.aggregate(F.zip_with("centre", "c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))) - F.col("reach") - F.col("r") > math.acos(threshold) + 1e-6


def _within_reach(some: DataFrame, others: DataFrame, name: str, threshold: float) -> DataFrame:
    """Pairs (name <= other) of the same dimension that a link can join; both tables have a row for thousands of vectors."""
    last = some.agg(F.max(name)).first()[0]
    every = some.select("dim", name, "centre", "reach", F.explode(F.sequence(F.col(name), F.lit(-1 if last is None else last))).alias("other"))
    theirs = others.select("dim", F.col(name).alias("other"), F.col("centre").alias("c"), F.col("reach").alias("r"))
    return every.join(theirs, ["dim", "other"]).filter((F.col(name) == F.col("other")) | ~_apart(threshold))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every vector.

    n_links counts the other vectors with a cosine of ``threshold`` or more, component_id is the least id
    that links reach. Null, empty and zero vectors and those with null or non-finite components link with
    nothing; so do vectors of different lengths. Rows that share an id are one vector (the least); those
    with null ids are one that links with nothing. Other columns, whatever their names, are not read. An empty table gives an empty table.
    """
    rows = vectors.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(vec_col).alias("vec"))
    usable = store(rows.filter("id IS NOT NULL").mapInArrow(_usable, "id long, digest binary, vec array<double>, signs int"), "vectors")
    copies = usable.groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"))
    copies = store(copies, "copies")
    members = usable.select("id", "digest").join(copies, "digest").select("id", "node", "copies")
    nodes = usable.join(copies.withColumnRenamed("node", "id"), ["digest", "id"]).select(F.col("id").alias("node"), "copies", "vec", F.size("vec").alias("dim"), "signs")
    nodes = ranked(nodes, "dim", "signs", "node").withColumn("block", F.expr(f"rank DIV {BLOCK}"))
    kinds = "dim int, block long, centre array<double>, reach double, ids binary, times binary, raw binary, code binary, scale binary, error binary"
    blocks = store(nodes.groupBy("dim", "block").applyInArrow(_pack, kinds), "blocks")

    marks = blocks.select("dim", "block", F.expr(f"block DIV {SPAN}").alias("region"), "centre", "reach")
    regions = store(marks.groupBy("dim", "region").applyInPandas(_region, "dim int, region long, centre array<double>, reach double"), "regions")
    met = _within_reach(regions, regions, "region", threshold).select("dim", "region", "other")
    mine = met.join(marks, ["dim", "region"])
    theirs = marks.select("dim", F.col("region").alias("other"), F.col("block").alias("with"), F.col("centre").alias("c"), F.col("reach").alias("r"))
    tiles = mine.join(theirs, ["dim", "other"]).filter((F.col("block") <= F.col("with")) & ((F.col("block") == F.col("with")) | ~_apart(threshold)))
    tiles = tiles.select("dim", "block", F.col("with").alias("other"))

    def joined_tiles(tiles: DataFrame, *names: str) -> DataFrame:
        left = blocks.select("dim", "block", *(F.col(n).alias("l" + n) for n in names))
        right = blocks.select("dim", F.col("block").alias("other"), *(F.col(n).alias("r" + n) for n in names))
        return tiles.join(left, ["dim", "block"]).join(right, ["dim", "other"])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pairs (a, b) that may reach the threshold; of a tile with more than ``FEW``, one row without a pair."""
        names = ("dim", "block", "other", "a", "b")
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch[n][k].as_py() for n in batch.schema.names}
                left, right = _Block(row, "l", row["dim"]), _Block(row, "r", row["dim"])
                pairs, n = [], 0
                for i, j in _near(left, right, False, threshold):
                    pairs.append((left.ids[i], right.ids[j]))
                    n += len(i)
                    if n > FEW:
                        break
                ids = [pa.array([None], pa.int64())] * 2 if n > FEW else [pa.array(np.concatenate(x)) for x in zip(*pairs, strict=True)]
                n = len(ids[0])
                yield pa.RecordBatch.from_arrays([pa.array([row["dim"]] * n, pa.int32()), *(pa.array([row[c]] * n, pa.int64()) for c in names[1:3]), *ids], names)

    def recompute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Both ends of the pairs that reach it in double precision."""
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims):
                some = batch.filter(pa.array(dims == dim))
                vectors = [some[c].flatten().to_numpy().reshape(-1, dim) for c in ("va", "vb")]
                hit = some.filter(pa.array(_cosine(*vectors) >= threshold))
                a, b, na, nb = (hit[c].to_numpy() for c in ("a", "b", "na", "nb"))
                low = np.minimum(a, b)
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[x, y]) for x, y in ((a, b), (nb, na), (low, low))], ["node", "n", "root"])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch[n][k].as_py() for n in batch.schema.names}
                a, b, same = _Block(row, "l", row["dim"]), _Block(row, "r", row["dim"]), row["block"] == row["other"]
                i, j = _tile(a, b, same, threshold)
                ids, times = (a.ids, a.times) if same else (np.r_[a.ids, b.ids], np.r_[a.times, b.times])
                out = _linked(ids, times, i, j if same else j + len(a.ids))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["node", "n", "root"])

    quantised = ("ids", "times", "code", "scale", "error")
    seen = store(joined_tiles(tiles.filter("block <> other"), *quantised).mapInArrow(look, "dim int, block long, other long, a long, b long"), "seen")
    dense = store(seen.filter("a IS NULL").select("dim", "block", "other").unionByName(tiles.filter("block = other")), "dense")
    dense = joined_tiles(dense, *quantised, "raw").mapInArrow(multiply, "node long, n long, root long")
    vectors = nodes.select("node", "copies", "vec")
    left = vectors.select(F.col("node").alias("a"), F.col("copies").alias("na"), F.col("vec").alias("va"))
    right = vectors.select(F.col("node").alias("b"), F.col("copies").alias("nb"), F.col("vec").alias("vb"))
    pairs = seen.filter("a IS NOT NULL").select("dim", "a", "b").join(left, "a").join(right, "b")
    few = pairs.select("dim", "a", "b", "na", "nb", "va", "vb").mapInArrow(recompute, "node long, n long, root long")
    found = store(dense.unionByName(few), "found")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    comps = components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("id", "node")
    out = members.join(counts, "node", "left").join(comps, "node", "left")
    out = out.select("id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    every = rows.select("id").join(out, "id", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return every.withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


OP1_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS l FROM v),
k AS (SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
      WHERE list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, k.b FROM r JOIN k ON k.a = r.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
d AS (SELECT a AS vec_id, count(*) AS n_links FROM k GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM c LEFT JOIN d USING (vec_id)
"""
