"""Removal of repeated word windows by super-k-mer partitioning.

A window is ``N`` consecutive words of one document; its minimiser is the least hash among the
``M``-word m-mers inside it. Consecutive windows that share a minimiser are a super-k-mer: one
packed string, which travels to the minimiser's bucket. There, sorting brings equal windows together,
their words are compared, and all but the earliest (smaller id, then earlier start) are marked.

A task first does the same for the texts it holds in a step: a window that is not the earliest of its step
is marked at once and doesn't travel, so a passage that many documents share is sent once by each step.
A first pass counts the windows of every minimiser over all texts, however thinly they are spread; the
windows of very frequent minimisers travel one by one, to the bucket of their own hash, so that no bucket
holds a large part of the corpus.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LEAST_ID, U64, Words, joined, mix, rolling, sliding_min, store, table

N, M = 20, 3
#: Text bytes that a step holds as arrays, and bytes of packed strings that it gathers before it hands them on.
STEP_BYTES, FLUSH_BYTES = 4 << 20, 2 << 20
#: Text bytes that a bucket is meant to hold as super-k-mers.
BUCKET_BYTES = 8 << 20
#: At most this many minimisers can be hot: each holds at least its share of all windows.
HOT_MOST = 1_000_000
#: A minimiser of no more windows than this isn't hot.
LEAST_HOT = 1000
#: Minimisers whose counts a task gathers before it hands them on.
COUNTS_HELD = 1 << 19


def _places(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text and the first word of each window of texts with these ranges of words."""
    n = np.maximum(np.diff(bounds) - N + 1, 0)
    text = np.repeat(np.arange(len(n), dtype=np.int32), n)
    skipped = bounds[:-1] - np.cumsum(n) + n
    return text, (np.arange(len(text)) + skipped[text]).astype(np.int64 if bounds[-1] >> 31 else np.int32)


def _minimisers(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    return sliding_min(rolling(h, M), N - M + 1)[at]


class Windows:
    """The windows of some texts: their first words, hashes and minimisers' hashes."""

    def __init__(self, words: Words, bounds: np.ndarray):
        self.h = words.hashes()
        self.packed, self.starts, self.ends = words.packed()
        self.text, self.at = _places(bounds)
        self.place = (self.at - bounds[:-1][self.text]).astype(np.int32)
        self.hash = rolling(self.h, N)[self.at]

    def minimisers(self) -> np.ndarray:
        return _minimisers(self.h, self.at)

    def bytes(self, first: int, last: int) -> memoryview:
        """The words from window ``first`` to window ``last`` (both included)."""
        return self.packed[self.starts[self.at[first]] : self.ends[self.at[last] + N - 1]].data

    def equal(self, some: np.ndarray, like: np.ndarray) -> np.ndarray:
        """Whether windows ``some`` (ascending) have the words of windows ``like``."""
        out = np.ones(len(some), bool)
        if not len(some):
            return out
        gap = np.r_[True, (np.diff(self.at[some]) != 1) | (np.diff(self.at[like]) != 1) | (np.diff(self.text[some]) != 0)]
        cuts = np.r_[np.flatnonzero(gap), len(some)].tolist()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if self.bytes(some[a], some[b - 1]) != self.bytes(like[a], like[b - 1]):
                out[a:b] = [self.bytes(some[k], some[k]) == self.bytes(like[k], like[k]) for k in range(a, b)]
        return out

    def later(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Windows that an equal one precedes by (id, start), and windows equal in all to one that is kept."""
        later, twice = np.zeros(len(self.at), bool), np.zeros(len(self.at), bool)
        if not len(self.at):
            return later, twice
        order = np.lexsort((starts, ids, self.hash))
        new = np.r_[True, self.hash[order][1:] != self.hash[order][:-1]]
        first = np.empty(len(order), np.int64)
        first[order] = np.repeat(order[new], np.diff(np.r_[np.flatnonzero(new), len(order)]))
        some = np.flatnonzero(first != np.arange(len(first)))
        same = self.equal(some, first[some])
        after = (ids[some] != ids[first[some]]) | (starts[some] != starts[first[some]])
        later[some[same & after]] = True
        twice[some[same & ~after]] = True
        known: dict[bytes, tuple] = {}
        for k in order[np.isin(order, some[~same])] if not same.all() else ():  # equal hashes of unequal words
            key, own = bytes(self.bytes(k, k)), (ids[k], starts[k])
            later[k] = known.setdefault(key, own) != own
        return later, twice


def _runs(*equal_if_same: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Where a run of windows begins: any of the values changes, or ``step`` isn't one more."""
    new = np.diff(step) != 1
    for x in equal_if_same:
        new |= x[1:] != x[:-1]
    return np.flatnonzero(np.r_[True, new]) if len(step) else np.empty(0, np.int64)


#: Id, digest, first window and number of windows of each string.
_PARTS = ("<i8", "<i8", "<i4", "<i4")


def _write(parts: list[np.ndarray], text: bytes) -> bytes:
    return zstandard.compress(b"".join([np.int64(len(parts[0])).tobytes(), *(p.astype(kind).tobytes() for p, kind in zip(parts, _PARTS, strict=True)), text]), 3)


def _read(blob: bytes) -> tuple[list[np.ndarray], bytes]:
    raw, at, parts = zstandard.decompress(blob), 8, []
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    for kind in _PARTS:
        parts.append(np.frombuffer(raw, kind, n, at))
        at += parts[-1].nbytes
    return parts, raw[at:]


def _in_order(batch: pa.RecordBatch) -> pa.RecordBatch:
    return batch.take(pa.array(np.argsort(batch["id"].to_numpy(), kind="stable")))


def _counted(kinds: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    kind, which = np.unique(np.concatenate(kinds), return_inverse=True)
    return kind, np.bincount(which, np.concatenate(times), len(kind)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(minimiser, windows) of a task's texts, summed as far as ``COUNTS_HELD`` allows."""
    kinds, times, held = [], [], 0
    rows = lambda k, n: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["kind", "n"])
    for batch in joined(batches, limit=STEP_BYTES):
        words = Words(batch["text"])
        kind, n = np.unique(_minimisers(words.hashes(), _places(words.bounds)[1]), return_counts=True)
        kinds.append(kind)
        times.append(n)
        held += len(kind)
        if held > COUNTS_HELD:
            kinds, times = ([x] for x in _counted(kinds, times))
            held = len(kinds[0])
            if 2 * held > COUNTS_HELD:
                yield rows(kinds[0], times[0])
                kinds, times, held = [], [], 0
    if kinds:
        yield rows(*_counted(kinds, times))


def _send(buckets: int, hot: np.ndarray):
    """Super-k-mers, packed by bucket; runs of windows marked already go to buckets below 0.

    ``hot`` has the hot minimisers in ascending order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out_bucket, out_blob, held = [], [], 0

        def packed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int64()), pa.array(out_blob, pa.binary())], ["bucket", "strings"])

        for batch in joined(batches, limit=STEP_BYTES):
            batch = _in_order(batch)
            words = Words(batch["text"])
            w = Windows(words, words.bounds)
            del words
            ids, digests = batch["id"].to_numpy(), batch["digest"].to_numpy()
            later, twice = w.later(ids[w.text], w.place)

            marked = np.flatnonzero(later)
            begin = _runs(w.text[marked], step=w.at[marked])
            if len(begin):
                text = w.text[marked][begin]
                out_bucket.append(-1 - int(w.hash[marked[0]] % U64(buckets)))
                out_blob.append(_write([ids[text], digests[text], w.place[marked][begin], np.diff(np.r_[begin, len(marked)])], b""))
                held += len(out_blob[-1])

            go = np.flatnonzero(~later & ~twice)
            del later, twice, marked
            least = w.minimisers()[go]
            single = _among(least, hot)
            new = np.zeros(len(go), bool)
            new[_runs(least, w.text[go], step=w.at[go])] = True
            begin = np.flatnonzero(new | single | np.r_[False, single[:-1]])
            del new
            size = np.diff(np.r_[begin, len(go)])
            first = go[begin]
            goal = (np.where(single[begin], w.hash[first], mix(least[begin])) % U64(buckets)).astype(np.int64)
            del least, single, go, begin
            a, b = w.starts[w.at[first]], w.ends[w.at[first] + size + N - 2] + 1
            order = np.argsort(goal, kind="stable")
            ordered = goal[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]), len(ordered)].tolist() if len(order) else []
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                some = order[x:y]
                text = w.text[first[some]]
                out_bucket.append(int(ordered[x]))
                out_blob.append(_write([ids[text], digests[text], w.place[first[some]], size[some]], b"".join([w.packed[i:j].data for i, j in zip(a[some].tolist(), b[some].tolist(), strict=True)])))
                held += len(out_blob[-1])
                if held > FLUSH_BYTES:
                    yield packed()
                    out_bucket, out_blob, held = [], [], 0
        if out_blob:
            yield packed()

    return run


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are among ``some``, which ascend."""
    if not len(some):
        return np.zeros(len(values), bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _mark(group: pa.Table) -> pa.Table:
    """Runs (id, digest, start, size) of windows to remove, of one bucket's super-k-mers."""
    parts, texts = [], []
    for blob in group["strings"]:
        part, text = _read(blob.as_py())
        parts.append(part)
        texts.append(text)
    ids, digests, starts, sizes = (np.concatenate(p) for p in zip(*parts, strict=True))
    if group["bucket"][0].as_py() >= 0:
        bounds = np.r_[0, np.cumsum(sizes + N - 1)]
        w = Windows(Words(data=np.frombuffer(b"".join(texts), np.uint8)), bounds)
        later, _ = w.later(ids[w.text], starts[w.text] + w.place)
        marked = np.flatnonzero(later)
        begin = _runs(w.text[marked], step=w.at[marked])
        text = w.text[marked][begin]
        ids, digests, starts, sizes = ids[text], digests[text], starts[text] + w.place[marked][begin], np.diff(np.r_[begin, len(marked)])
    return pa.table({"id": pa.array(ids, pa.int64()), "digest": pa.array(digests, pa.int64()), "start": pa.array(starts.astype(np.int32)), "size": pa.array(sizes.astype(np.int32))})


def _cover(n: int, runs: list[dict] | None) -> np.ndarray:
    """Which of ``n`` words the windows of these runs cover."""
    steps = np.zeros(n + 1, np.int32)
    for r in runs or ():
        steps[r["start"]] += 1
        steps[min(n, r["start"] + r["size"] + N - 1)] -= 1
    return np.cumsum(steps[:-1]) > 0


def hot_share(windows: int, buckets: int) -> int:
    """The windows that a minimiser has at most without being hot."""
    return max(windows // (2 * buckets), windows // HOT_MOST, LEAST_HOT)


def repeated_windows(src: DataFrame) -> DataFrame:
    """Runs of windows to remove, for ``src`` (id, digest, text); the digest only tells apart rows that share an id."""
    bytes_ = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-3 * bytes_ // BUCKET_BYTES))
    counts = src.mapInArrow(_count, "kind long, n long").groupBy("kind").agg(F.sum("n").alias("n"))
    # what can't be hot becomes one row
    counts = store(counts.groupBy(F.when(F.col("n") > LEAST_HOT, F.col("kind")).alias("kind")).agg(F.sum("n").alias("n")), "minimisers")
    windows = counts.agg(F.sum("n")).first()[0] or 0
    # HOT_MOST at most, as each has its share of the windows
    hot = np.sort(np.array([r["kind"] for r in counts.filter((F.col("n") > hot_share(windows, buckets)) & F.col("kind").isNotNull()).select("kind").collect()], np.int64).view(U64))
    sent = src.mapInArrow(_send(buckets, hot), "bucket long, strings binary")
    return store(sent.groupBy("bucket").applyInArrow(_mark, "id long, digest long, start int, size int"), "windows")


def dedup_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept_text]) of every row of ``docs``: words that a window
    covers whose words also start earlier are removed.

    Ids are longs; a null one counts as the least long. Null and empty texts, and texts of fewer than ``N``
    words, lose nothing. Rows that share an id are one document: of two equal windows at the same start of
    such rows neither is earlier, so repeated rows give repeated results; texts that share an id are told apart by 64-bit hashes. A very long text is a step of its
    own, so a task needs memory for its longest text. Other columns, whatever their names, are not read. An
    empty table gives an empty table.
    """
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("id"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    # a set: repeated rows find the same runs, each of them
    runs = repeated_windows(src).groupBy("id", "digest").agg(F.collect_set(F.struct("start", "size")).alias("runs"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches):
            words = Words(batch["text"])
            packed, starts, ends = words.packed()
            b = words.bounds
            all_runs = batch["runs"].to_pylist()
            gone = [_cover(int(y - x), r) for x, y, r in zip(b[:-1], b[1:], all_runs, strict=True)]
            keep = ~np.concatenate([np.empty(0, bool), *gone])
            sizes = (ends - starts + 1) * keep
            data = packed[np.repeat(keep, ends - starts + 1)].tobytes()
            at = np.r_[0, np.cumsum(sizes)][b].tolist()
            kept = [data[x : max(x, y - 1)] for x, y in zip(at[:-1], at[1:], strict=True)]
            cols = [batch["id"], pa.array(np.diff(b)), pa.array([int(g.sum()) for g in gone], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array([k.decode() for k in kept], pa.string())] if kept_text else [])], names)

    names = [id_col, "n_words", "n_removed", "kept_sha256", *(["kept_text"] if kept_text else [])]
    found = src.join(runs, ["id", "digest"], "left").select("id", "text", "runs")
    out = found.mapInArrow(finish, f"`{id_col}` long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * kept_text)
    return out.withColumn(id_col, F.nullif(id_col, F.lit(LEAST_ID)))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.withColumn("has_repeats", F.col("n_removed") > 0)


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
k AS (SELECT doc_id, i, sha256(array_to_string(ws[i : i + 19], ' ')) AS win
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS n FROM k) WHERE n > 1),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM r),
e AS (SELECT doc_id, ws[p] AS word, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM w)),
s AS (SELECT e.doc_id, count(*) FILTER (g.p IS NOT NULL) AS n_removed,
        coalesce(string_agg(word, ' ' ORDER BY e.p) FILTER (g.p IS NULL), '') AS kept
      FROM e LEFT JOIN g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_removed, 0) > 0 AS has_repeats
FROM w LEFT JOIN s USING (doc_id)
"""
