"""Token ids packed into rows of one width, by best-fit decreasing.

Texts are tokenised and cut into parts of up to ``width`` ids, so an overlong document loses nothing.
Parts are dealt by a hash of their document and ids to shards of bounded size, repeated rows by their number in their task, too. In a shard, the longest part goes first, each to the
fullest row that still has room; a segment tree over the room left finds that row. A shard's rows are
written as blocks: the id matrix, the cumulative lengths of its segments, and position ids that start
anew with each segment.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, table

WIDTH, BLOCK_ROWS = 2048, 256
#: Bytes of text that a shard is meant to hold.
SHARD_BYTES = 8 << 20
#: Parts whose repetitions a task counts at once.
COUNTED = 1 << 18
#: Tasks that shards are dealt to at most; beyond, a task packs several, one after the other.
PARTITIONS = 1 << 16


class Room:
    """Rows by the room they have left, with the least room that fits in O(log width) steps."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        node = self.size + room
        while node:
            self.count[node] += 1
            node //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """(room, row) of the fullest row with room for ``need``, which is taken out."""
        node = self.size + need
        if not self.count[node]:
            while node > 1 and (node % 2 or not self.count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (not self.count[2 * node])
        room = node - self.size
        row = self.rows[room].pop()
        while node:
            self.count[node] -= 1
            node //= 2
        return room, row


def best_fit(lengths: list[int], width: int) -> list[tuple[int, int]]:
    """(row, offset) of each part; ``lengths`` are in descending order."""
    room, out, rows = Room(width), [], 0
    for n in lengths:
        left, row = room.take(n) or (width, rows)
        rows += row == rows
        out.append((row, width - left))
        if left > n:
            room.add(left - n, row)
    return out


class Ids:
    """A tokenizer file of ``base64 rank`` lines, loaded once in each worker."""

    _made: dict[str, Ids] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Ids:
        if path not in cls._made:
            cls._made[path] = cls(path, pattern)
        return cls._made[path]

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(x): int(r) for x, r in (line.split() for line in file if line.strip())}
        self.pad = len(ranks)
        self.kind = "<u2" if self.pad < 1 << 16 else "<u4"
        self.encode = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


BLOCKS = "shard long, block int, n_rows int, width int, ids binary, cumulative array<int>, positions binary, segments array<struct<id: long, part: int, row: int, offset: int, length: int>>"


def packed(docs: DataFrame, path: str, pattern: str, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of packed rows: ``ids`` (n_rows x width, little-endian, 2 bytes an id where the vocabulary
    allows it, else 4; the first free id fills up), ``cumulative`` (0 and the end of each segment, counted over
    the block's segments in order of row and offset), ``positions`` (n_rows x width, 2 or 4 bytes) and ``segments``.

    Null and empty texts have no ids and so no segment. Repeated rows are packed each by itself and spread like others. Ids are
    longs and may be null; such rows are told apart by their ids. Ties in length go by id and part. A very long text is cut in parts of ``width`` ids, which go to
    shards of their own. Other columns, whatever their names, are not read. An empty table gives an empty table.
    """
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    place = "<u2" if width <= 1 << 16 else "<u4"

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, task = Ids.of(path, pattern), TaskContext.get().partitionId()
        seen: Counter = Counter()
        for batch in chunks(batches):
            rows = []
            for i, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = np.array(codec.encode(text or ""), codec.kind)
                for k in range(0, len(ids), width):
                    cut = ids[k : k + width].tobytes()
                    key = hashlib.blake2b(cut, digest_size=8, key=repr((i, k)).encode()).digest()
                    again = seen[key]
                    seen[key] += 1
                    if again:  # a repeated row goes elsewhere
                        key = hashlib.blake2b(key, digest_size=8, key=repr((task, again)).encode()).digest()
                    rows.append((i, k // width, len(cut) // ids.itemsize, cut, int.from_bytes(key, "little") % shards))
            if len(seen) > COUNTED:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int64()))], ["id", "part", "n", "ids", "shard"])

    def pack(group: pa.Table) -> pa.Table:
        codec = Ids.of(path, pattern)
        group = group.sort_by([("n", "descending"), ("id", "ascending"), ("part", "ascending"), ("ids", "ascending")])
        lengths = group["n"].to_pylist()
        where = best_fit(lengths, width)
        order = sorted(range(len(where)), key=where.__getitem__)
        data, ids, part = group["ids"].to_pylist(), group["id"].to_pylist(), group["part"].to_pylist()
        out, at = [], 0
        while at < len(order):
            first = where[order[at]][0] // BLOCK_ROWS * BLOCK_ROWS
            end = at
            while end < len(order) and where[order[end]][0] < first + BLOCK_ROWS:
                end += 1
            some = order[at:end]
            rows = where[some[-1]][0] - first + 1
            matrix, positions = np.full((rows, width), codec.pad, codec.kind), np.zeros((rows, width), place)
            segments = []
            for k in some:
                row, offset, n = where[k][0] - first, where[k][1], lengths[k]
                matrix[row, offset : offset + n] = np.frombuffer(data[k], codec.kind)
                positions[row, offset : offset + n] = np.arange(n)
                segments.append({"id": ids[k], "part": part[k], "row": row, "offset": offset, "length": n})
            ends = np.cumsum([0, *(s["length"] for s in segments)]).tolist()
            out.append({"shard": group["shard"][0].as_py(), "block": first // BLOCK_ROWS, "n_rows": rows, "width": width, "ids": matrix.tobytes(), "cumulative": ends, "positions": positions.tobytes(), "segments": segments})
            at = end
        segment = pa.struct([("id", pa.int64()), *((n, pa.int32()) for n in ("part", "row", "offset", "length"))])
        kinds = pa.schema([("shard", pa.int64()), ("block", pa.int32()), ("n_rows", pa.int32()), ("width", pa.int32()), ("ids", pa.binary()), ("cumulative", pa.list_(pa.int32())), ("positions", pa.binary()), ("segments", pa.list_(segment))])
        return pa.Table.from_pylist(out, kinds)

    dealt = src.mapInArrow(parts, "id long, part int, n int, ids binary, shard long")
    return dealt.repartition(min(shards, PARTITIONS), "shard").groupBy("shard").applyInArrow(pack, BLOCKS)


def write(blocks: DataFrame, path: str) -> None:
    """Write blocks as Parquet: one row a block, matrices as binaries."""
    blocks.write.mode("overwrite").option("compression", "zstd").parquet(path)


def segments(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row for each segment, cut out of the blocks' matrices: id, part, shard, row, start, length, digest
    of its ids (as little-endian unsigned 32-bit integers), and whether its positions start anew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.to_pylist():
                rows, width = block["n_rows"], block["width"]
                kind = "<u2" if len(block["ids"]) == 2 * rows * width else "<u4"
                place = "<u2" if len(block["positions"]) == 2 * rows * width else "<u4"
                matrix = np.frombuffer(block["ids"], kind).reshape(rows, width)
                positions = np.frombuffer(block["positions"], place).reshape(rows, width)
                out = []
                for k, s in enumerate(block["segments"]):
                    cut = slice(s["offset"], s["offset"] + s["length"])
                    ids = matrix[s["row"], cut].astype("<u4").tobytes()
                    fresh = bool((positions[s["row"], cut] == np.arange(s["length"])).all()) and block["cumulative"][k + 1] - block["cumulative"][k] == s["length"]
                    out.append((s["id"], s["part"], block["shard"], block["block"] * BLOCK_ROWS + s["row"], s["offset"], s["length"], hashlib.sha256(ids).hexdigest(), fresh))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)

    names = [id_col, "part", "shard", "row", "start", "length", "ids_sha256", "positions_reset"]
    return blocks.mapInArrow(run, f"`{id_col}` long, part int, shard long, row long, start int, length int, ids_sha256 string, positions_reset boolean")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return segments(packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))
