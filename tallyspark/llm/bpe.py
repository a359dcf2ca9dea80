"""Byte-level BPE over whole texts: recursive DuckDB queries encode, an ordered aggregation decodes.

Spark partitions the documents. Inside a task, each text is cut into pieces by the tokenizer's
pattern; the pieces that the task's worker has not met yet become rows (piece, position, id) of a
DuckDB table. A recursive query joins them to the merge table and contracts, in each piece, the
leftmost pair of least rank, until no pair is left. A piece's ids don't depend on what stands
around it, so a bounded cache of the worker keeps them.

The recursion keeps a row for each token of each step, so a query takes as many pieces as make about
``QUERY_ROWS`` rows. Pieces of more than ``LONG_PIECE`` bytes (a run of one sign, say) leave the query: they would
make about half the square of their bytes in rows, over as many steps. A heap contracts the same pairs in the same
order there.

Null and empty texts have no ids. Texts may have any length: long ones are cut, encoded and decoded piece by piece, in
blocks. Any other columns travel along unchanged; repeated rows are encoded each by itself; ids may be null. An empty table
gives an empty table. If a new column's name is taken, it gets underscores until it is free.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, free_name, table

#: Pieces of more bytes than this are merged with a heap: the query takes a step for each contraction,
#: and such a piece (a run of one sign, say) would need hundreds.
LONG_PIECE = 256
#: Pieces whose ids a worker keeps and bytes of their texts, and rows that one recursive query may make.
CACHE_PIECES, CACHE_BYTES, QUERY_ROWS = 600_000, 16 << 20, 2_000_000
#: Bytes of text from which a text is cut into pieces block by block, pieces of a block, and ids that are decoded at once.
LONG_TEXT, BLOCK_PIECES, BLOCK_IDS = 4 << 20, 200_000, 1 << 20

#: A token is (piece, pos, stop, id, nxt): it covers bytes pos to stop, nxt is the id at stop (-1: none).
#: Contracting the pair at ``hit`` drops its left token and widens its right one, which knows its own nxt.
#: k packs (merged id, position, middle), so its least value is the leftmost pair of least rank.
ENCODE_SQL = """
WITH RECURSIVE t(piece, pos, stop, id, nxt, step) AS (
    SELECT piece, pos, (pos + 1)::INTEGER, id, nxt, 0::SMALLINT FROM start
  UNION ALL
    SELECT t.piece, CASE WHEN t.pos = mid THEN hit ELSE t.pos END, t.stop,
           CASE WHEN t.pos = mid THEN merged ELSE t.id END,
           CASE WHEN t.stop = hit THEN merged ELSE t.nxt END, (t.step + 1)::SMALLINT
    FROM t JOIN (
        SELECT piece, (k >> 32)::INTEGER AS merged, (k >> 16 & 65535)::INTEGER AS hit, (k & 65535)::INTEGER AS mid
        FROM (SELECT t.piece, min((m.merged::BIGINT << 32) + (t.pos << 16) + t.stop) AS k
              FROM t JOIN merges m ON m.l = t.id AND m.r = t.nxt GROUP BY t.piece)
    ) b ON b.piece = t.piece
    WHERE t.pos <> hit
)
SELECT t.piece, t.id FROM t
JOIN (SELECT piece, max(step) AS step FROM t GROUP BY piece) l ON l.piece = t.piece AND l.step = t.step
ORDER BY t.piece, t.pos
"""

DECODE_SQL = "SELECT doc, list(bytes ORDER BY pos) AS parts FROM tokens JOIN vocab USING (id) GROUP BY doc ORDER BY doc"


class Codec:
    """Encoder and decoder of one vocabulary file (``base64 rank`` lines) for one worker process."""

    _made: dict[tuple[str, str], Codec] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        with open(path, "rb") as file:
            self.ranks = {base64.b64decode(x): int(r) for x, r in (line.split() for line in file if line.strip())}
        self.pattern = regex.compile(pattern)
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        self.held = 0
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                if (a := self.ranks.get(token[:k])) is not None and (b := self.ranks.get(token[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    merged.append(rank)
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        ints = lambda x: pa.array(x, pa.int32())
        self.con.register("m", pa.table({"l": ints(left), "r": ints(right), "merged": ints(merged)}))
        self.con.register("v", pa.table({"id": ints(list(self.ranks.values())), "bytes": pa.array(list(self.ranks), pa.binary())}))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM m; CREATE TABLE vocab AS SELECT * FROM v")
        self.con.unregister("m")
        self.con.unregister("v")

    def _heap(self, piece: bytes) -> list[int]:
        """Ids of a long piece by the same contractions, with a heap of pairs."""
        ids, n = [int(self.single[b]) for b in piece], len(piece)
        stop, back = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: self.ranks.get(piece[i : stop[stop[i]]]) if stop[i] < n else None
        heap = [(r, i, stop[stop[i]]) for i in range(n) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, end = heapq.heappop(heap)
            if ids[i] < 0 or stop[i] >= n or stop[stop[i]] != end or self.ranks.get(piece[i:end]) != r:
                continue
            ids[i], ids[stop[i]], stop[i] = r, -1, end
            if end < n:
                back[end] = i
            for j in (i, back[i]):
                if j >= 0 and (q := rank(j)) is not None:
                    heapq.heappush(heap, (q, j, stop[stop[j]]))
        return [x for x in ids if x >= 0]

    def _contract(self, pieces: list[bytes]) -> list[bytes]:
        n = np.array([len(p) for p in pieces])
        ends = np.cumsum(n)
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        nxt = np.r_[ids[1:], -1].astype(np.int32)
        nxt[ends - 1] = -1
        pos = (np.arange(len(ids)) - np.repeat(ends - n, n)).astype(np.int32)
        self.con.register("start", pa.table({"piece": np.repeat(np.arange(len(pieces), dtype=np.int32), n), "pos": pos, "id": ids, "nxt": nxt}))
        got = self.con.sql(ENCODE_SQL).to_arrow_table()
        self.con.unregister("start")
        cuts = np.searchsorted(got["piece"].to_numpy(), np.arange(len(pieces) + 1)) * 4
        data = got["id"].to_numpy().astype("<u4").tobytes()
        return [data[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def learn(self, pieces: set[str]) -> None:
        """Put the ids of these pieces into the cache."""
        short: list[tuple[int, str, bytes]] = []
        for piece in pieces:
            raw = piece.encode()
            self.held += len(raw)
            if (whole := self.ranks.get(raw)) is not None:
                self.cache[piece] = whole.to_bytes(4, "little")
            elif len(raw) > LONG_PIECE:
                self.cache[piece] = np.array(self._heap(raw), "<u4").tobytes()
            else:
                short.append((len(raw), piece, raw))
        short.sort()
        at = 0
        while at < len(short):
            end, rows = at, 0
            while end < len(short) and (end == at or rows + short[end][0] * (short[end][0] + 1) // 2 <= QUERY_ROWS):
                rows += short[end][0] * (short[end][0] + 1) // 2  # at most: one token less in each step
                end += 1
            part = short[at:end]
            self.cache.update(zip((p for _, p, _ in part), self._contract([raw for _, _, raw in part]), strict=True))
            at = end

    def _ids(self, cut: list[list[str]]) -> list[bytes]:
        """The ids of lists of pieces."""
        new = set().union(*cut).difference(self.cache)
        if len(self.cache) + len(new) > CACHE_PIECES or self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
            new = set().union(*cut)
        self.learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, pieces)) for pieces in cut]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        texts = [t or "" for t in texts]
        out = self._ids([self.pattern.findall(t) if len(t) <= LONG_TEXT else [] for t in texts])
        for k, text in enumerate(texts):
            if len(text) > LONG_TEXT:
                matches, parts = self.pattern.finditer(text), []
                while pieces := [m[0] for m in islice(matches, BLOCK_PIECES)]:
                    parts += self._ids([pieces])
                out[k] = b"".join(parts)
        return out

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Each id sequence's bytes."""
        out: list[list[bytes]] = [[] for _ in ids]
        held, size = [], 0
        for k, x in enumerate(ids):
            for at in range(0, len(x), 4 * BLOCK_IDS):
                part = x[at : at + 4 * BLOCK_IDS]
                if held and size + len(part) > 4 * BLOCK_IDS:
                    self._decode(held, out)
                    held, size = [], 0
                held.append((k, part))
                size += len(part)
        if held:
            self._decode(held, out)
        return [b"".join(parts) for parts in out]

    def _decode(self, some: list[tuple[int, bytes]], out: list[list[bytes]]) -> None:
        """Add the bytes of (number, ids) to ``out`` at that number."""
        n = np.array([len(x) // 4 for _, x in some], np.int64)
        flat = np.frombuffer(b"".join(x for _, x in some), "<u4").astype(np.int32)
        pos = (np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        self.con.register("tokens", pa.table({"doc": np.repeat(np.arange(len(some), dtype=np.int32), n), "pos": pos, "id": flat}))
        got = self.con.sql(DECODE_SQL).to_arrow_table()
        self.con.unregister("tokens")
        for batch in got.to_batches():
            parts = batch["parts"]
            flat_parts, at = parts.flatten(), (parts.offsets.to_numpy() - parts.offsets[0].as_py()).tolist()
            ends = np.frombuffer(flat_parts.buffers()[1], np.int32)[flat_parts.offset : flat_parts.offset + len(flat_parts) + 1]
            data = flat_parts.buffers()[2].to_pybytes() if flat_parts.buffers()[2] else b""
            for k, doc in enumerate(batch["doc"].to_pylist()):
                out[some[doc][0]].append(data[ends[at[k]] : ends[at[k + 1]]])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: the text's ids as a binary of little-endian unsigned 32-bit integers. Map-only."""
    ids_col = free_name(ids_col, docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in chunks(batches, text_col):
            ids = codec.encode(batch[text_col].to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids, pa.binary())], [*batch.schema.names, ids_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids_col, T.BinaryType())]))


def decode(coded: DataFrame, path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``coded`` with ``out_col``: the bytes that the ids stand for (null ids: empty). Map-only."""
    out_col = free_name(out_col, coded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in chunks(batches, ids_col):
            raw = codec.decode([x or b"" for x in batch[ids_col].to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], [*batch.schema.names, out_col])

    return coded.mapInArrow(run, T.StructType([*coded.schema.fields, T.StructField(out_col, T.BinaryType())]))


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def digest(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode and decode whole texts; only counts and digests leave the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in chunks(batches):
            ids = codec.encode(batch["text"].to_pylist())
            raw = codec.decode(ids)
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(raw)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"), *default_vocabulary())
