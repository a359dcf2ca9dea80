"""Ranked lexical search: WAND over document shards, shard heaps merged.

Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, with A-Z in lower case. A first pass
over the documents makes an index: each task cuts its documents into shards and writes, for each shard, its postings (term,
document, occurrences) of the terms that the queries ask for, its documents' lengths and its counts. The counts of all shards
give N, L and each term's df, and so every weight.

A second pass reads the shards. In a shard, a term's maximum impact is its largest score in any of its documents. A query
keeps a cursor in each term's postings and a heap of its ``k`` best documents, which its task carries from shard to
shard. WAND sorts the cursors by their document; the first at which the sum of maximum impacts reaches the heap's
threshold is the pivot. No document before the pivot can enter the heap, so all cursors before it move on to it, and it alone
is scored. Queries take these steps side by side, as rows of arrays. The heaps of all tasks are merged by score.

Queries are searched in blocks of about ``BLOCK_TERMS`` terms, each against all documents, so what a task or the driver
holds of them is bounded. Scores are 64-bit integers but for the weights, which are rounded down from doubles.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import store, table

#: All bytes that end a term become spaces, and A-Z lower case; bytes of characters beyond ASCII stay.
FOLD = bytes(b if b >= 128 or chr(b).isalnum() and not 65 <= b <= 90 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
#: Terms that a block of queries has (an item with more makes a block of its own).
BLOCK_TERMS = 1 << 16
#: Documents of a shard at most, and postings from which one ends.
SHARD_DOCS, SHARD_POSTINGS = 1024, 1 << 18
#: Cells (term, document) that a task holds as arrays, and cells (query, term) that take a step side by side.
CELLS, STEP_CELLS = 1 << 22, 1 << 16
#: Bytes of a text that are cut into terms at once.
SLICE_BYTES = 4 << 20
#: Stands for a null document id: behind all others.
LAST_ID = (1 << 63) - 1

INDEX = "doc_ids binary, lengths binary, terms binary, docs binary, times binary, n_docs long, n_terms long, held array<int>, dfs array<int>"


def terms(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text in order, as UTF-8, in lists of bounded size."""
    raw = (text or "").encode().translate(FOLD)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= SLICE_BYTES else raw.find(b" ", at + SLICE_BYTES)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()  # FOLD leaves no white space but the space
        at = end


def _items(queries: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(item, term) of every item, each once; rows that share an item are one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, t) for i, text in zip(batch["item"].to_pylist(), batch["text"].to_pylist(), strict=True) for t in set().union(*terms(text))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch["item"].type), pa.array([r[1] for r in rows], pa.binary())], ["item", "term"])

    src = queries.select(F.col(item_col).alias("item"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"item {src.schema['item'].dataType.simpleString()}, term binary").distinct()


def index(docs: DataFrame, vocabulary: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """One row for each shard: document ids and lengths, postings of the vocabulary in order of term and document, and counts."""
    numbers = {t: k for k, t in enumerate(vocabulary)}

    def shard(ids: list, lengths: list, counts: list, found: list, times: list) -> pa.RecordBatch:
        numbered = np.array([LAST_ID if i is None else i for i in ids], np.int64)
        by_id = np.argsort(numbered, kind="stable")  # so that equal scores meet in order
        place = np.empty(len(ids), np.int32)
        place[by_id] = np.arange(len(ids))
        doc = np.repeat(place, counts)
        term, tf = np.array(found, np.int32), np.array(times, np.int64)
        order = np.lexsort((doc, term))
        held, dfs = np.unique(term, return_counts=True)
        raw = lambda x: pa.array([x.tobytes()], pa.binary())
        n = np.array(lengths, np.int64)[by_id]
        facts = [pa.array([int((n > 0).sum())], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([held], pa.list_(pa.int32())), pa.array([dfs], pa.list_(pa.int32()))]
        return pa.RecordBatch.from_arrays([raw(numbered[by_id]), raw(n), raw(term[order]), raw(doc[order]), raw(tf[order]), *facts], ["doc_ids", "lengths", "terms", "docs", "times", "n_docs", "n_terms", "held", "dfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, counts, found, times = [], [], [], [], []
        for batch in batches:
            for doc, text in zip(batch["id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                tally: Counter = Counter()
                n = 0
                for some in terms(text):
                    n += len(some)
                    tally.update(map(numbers.get, some))
                tally.pop(None, None)
                ids.append(doc)
                lengths.append(n)
                counts.append(len(tally))
                found.extend(tally)
                times.extend(tally.values())
                if len(ids) == SHARD_DOCS or len(found) >= SHARD_POSTINGS:
                    yield shard(ids, lengths, counts, found, times)
                    ids, lengths, counts, found, times = [], [], [], [], []
        if ids:
            yield shard(ids, lengths, counts, found, times)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, INDEX)


class Heaps:
    """The ``k`` best documents of each query, as rows of arrays: score, then the smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.doc = np.zeros((n, k), np.int64), np.full((n, k), LAST_ID)
        self.worst, self.least = np.zeros(n, np.int64), np.zeros(n, np.int64)  # the place that goes next, and its score

    def push(self, query: np.ndarray, score: np.ndarray, doc: np.ndarray) -> None:
        """Offer one document to each of these queries."""
        place = self.worst[query]
        low, last = self.score[query, place], self.doc[query, place]
        better = (score > 0) & ((score > low) | (score == low) & (doc < last))
        query, place = query[better], place[better]
        if len(query):
            self.score[query, place], self.doc[query, place] = score[better], doc[better]
            least = self.score[query].min(1)
            last = np.where(self.score[query] == least[:, None], self.doc[query], -(1 << 63))
            self.worst[query], self.least[query] = last.argmax(1), least


def _group(asked: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Queries of about as many terms together: (numbers of the queries, their terms as rows filled up with -1)."""
    out = []
    sizes = np.array([len(a) for a in asked])
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):
        wide = max(1, int(sizes[order[at]]) * 2)
        end = int(np.searchsorted(sizes[order], wide, side="right"))
        end = max(at + 1, min(end, at + STEP_CELLS // wide))
        some = order[at:end]
        rows = np.full((len(some), int(sizes[some].max())), -1)
        for k, q in enumerate(some):
            rows[k, : sizes[q]] = asked[q]
        out.append((some, rows))
        at = end
    return out


def wand(groups: list[tuple[np.ndarray, np.ndarray]], heaps: Heaps, ids: np.ndarray, term: np.ndarray, doc: np.ndarray, impact: np.ndarray, n_terms: int) -> int:
    """Search one shard's postings (in order of term and document) for all queries; returns how many documents were scored."""
    held, first = np.unique(term, return_index=True)
    row = np.full(n_terms + 1, len(held))  # the row of each term, the last one for terms that the shard lacks
    row[held] = np.arange(len(held))
    row[-1] = len(held)
    top = np.zeros(len(held) + 1, np.int64)
    if len(held):
        top[:-1] = np.maximum.reduceat(impact, first)
    scored, step = 0, max(1, CELLS // (len(held) + 1))
    for low in range(0, len(ids), step):  # documents that fit into the arrays
        n = min(step, len(ids) - low)
        some = slice(None) if n == len(ids) else np.flatnonzero((doc >= low) & (doc < low + n))
        at, r = doc[some] - low, row[term[some]]
        scores = np.zeros((len(held) + 1, n + 1), np.int64)
        scores[r, at] = impact[some]
        cursor = np.full((len(held) + 1, n + 2), n, np.int32)  # the first document of a term from each one on
        cursor[r, at] = at
        cursor[:, ::-1] = np.minimum.accumulate(cursor[:, ::-1], axis=1)
        for queries, asked in groups:
            scored += _search(queries, row[asked], heaps, ids[low : low + n], scores, cursor, top)
    return scored


def _search(queries: np.ndarray, rows: np.ndarray, heaps: Heaps, ids: np.ndarray, scores: np.ndarray, cursor: np.ndarray, top: np.ndarray) -> int:
    n, width = len(ids), rows.shape[1]
    bits = max(1, int(width - 1).bit_length())
    slot = np.arange(width)
    places, scored = cursor[rows, 0].astype(np.int64), 0
    best = top[rows]
    while len(queries):
        order = np.sort(places << bits | slot, axis=1)  # cursors by document
        reach = np.cumsum(np.take_along_axis(best, order & (1 << bits) - 1, 1), 1)
        # a document whose score could only equal the threshold may still win by its id
        enough = reach >= np.maximum(heaps.least[queries], 1)[:, None]
        at = enough.argmax(1)
        each = np.arange(len(queries))
        pivot = np.where(enough[each, at], order[each, at] >> bits, n)
        if not (pivot < n).all():
            on = pivot < n
            queries, rows, places, best, pivot = queries[on], rows[on], places[on], best[on], pivot[on]
            if not len(queries):
                break
        score = scores[rows, pivot[:, None]].sum(1)
        scored += len(queries)
        heaps.push(queries, score, ids[pivot])
        places = np.maximum(places, cursor[rows, pivot[:, None] + 1])
    return scored


def _weights(n: int, dfs: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(df) + 1))) for df in dfs], np.int64)


def _block(docs: DataFrame, pairs: list, k: int, id_col: str, text_col: str) -> DataFrame:
    """(number, doc, score) of the best of each task, for queries given as (number, term) rows."""
    numbers = sorted({p["number"] for p in pairs})
    vocabulary = sorted({bytes(p["term"]) for p in pairs})
    place = {t: j for j, t in enumerate(vocabulary)}
    asked: dict[int, list[int]] = {q: [] for q in numbers}
    for p in pairs:
        asked[p["number"]].append(place[bytes(p["term"])])
    shards = store(index(docs, vocabulary, id_col, text_col), "shards")
    total = shards.agg(F.sum("n_docs"), F.sum("n_terms")).first()
    n, every = total[0] or 0, total[1] or 0
    dfs = np.zeros(len(vocabulary), np.int64)
    counted = shards.select(F.explode(F.arrays_zip("held", "dfs")).alias("x")).groupBy("x.held").agg(F.sum("x.dfs").alias("df"))
    for r in counted.collect():  # a row for each term of the block
        dfs[r["held"]] = r["df"]
    weights = _weights(n, dfs)
    groups = _group([np.array(asked[q]) for q in numbers])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps = Heaps(len(numbers), k)
        for batch in batches:
            for j in range(batch.num_rows):
                ids, lengths, term, doc, times = (np.frombuffer(batch[c][j].as_buffer(), kind) for c, kind in (("doc_ids", np.int64), ("lengths", np.int64), ("terms", np.int32), ("docs", np.int32), ("times", np.int64)))
                m = np.array([100 - 90 + 90 * x * n // every if every else 0 for x in lengths.tolist()], np.int64)
                impact = weights[term] * (1000000000 * times // (1000 * times + 8 * m[doc]))
                wand(groups, heaps, ids, term, doc, impact, len(vocabulary))
        query, at = np.nonzero(heaps.score)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(numbers, np.int64)[query]), pa.array(heaps.doc[query, at]), pa.array(heaps.score[query, at])], ["number", "doc", "score"])

    return shards.select("doc_ids", "lengths", "terms", "docs", "times").mapInArrow(search, "number long, doc long, score long")


def search(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(item, rank, id, score): the ``k`` documents that score best for each item, with scores above 0.

    Equal scores go by ascending id, null ids last; repeated rows are documents each. Null, empty and term-less texts score
    nothing and aren't counted; items without terms, or whose terms no document holds, have no rows. Items that share an id
    are one query, null ids too. Very long texts are cut into terms slice by slice. Other columns, whatever their names, are
    not read. An empty table on either side gives an empty table.
    """
    pairs = store(_items(queries, item_col, item_text_col), "items")
    items = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n")).withColumn("number", F.monotonically_increasing_id())
    items = store(items, "numbered")
    n_blocks = -(-(items.agg(F.sum("n")).first()[0] or 0) // BLOCK_TERMS)
    block = F.pmod(F.xxhash64("number"), F.lit(max(1, n_blocks))).alias("block")
    numbered = items.select(F.col("item").alias("of"), "number", block)
    asked = store(pairs.join(numbered, F.col("item").eqNullSafe(F.col("of"))).select("block", "number", "term"), "asked")
    found = [_block(docs, some, k, id_col, text_col) for b in range(n_blocks) if (some := asked.filter(F.col("block") == b).select("number", "term").collect())]
    if not found:
        return docs.sparkSession.createDataFrame([], T.StructType([T.StructField(item_col, queries.schema[item_col].dataType), *T._parse_datatype_string(f"rank int, `{id_col}` long, score long").fields]))
    best = Window.partitionBy("number").orderBy(F.col("score").desc(), "doc")
    top = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    named = top.join(items.select("number", "item"), "number")
    doc = F.when(F.col("doc") < LAST_ID, F.col("doc"))
    return named.select(F.col("item").alias(item_col), "rank", doc.alias(id_col), "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH t AS (
    SELECT doc_id, row_number() OVER () AS r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM documents),
s AS (SELECT count(DISTINCT r) AS n_docs, count(*) AS n_terms FROM t),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
l AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM t GROUP BY r),
p AS (SELECT r, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * (SELECT n_docs FROM s) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p GROUP BY term),
i AS (SELECT p.r, l.doc_id, p.term, (w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * l.n * (SELECT n_docs FROM s)) // (SELECT n_terms FROM s))))) AS impact
      FROM p JOIN l USING (r) JOIN w USING (term)),
d AS (SELECT q.item_id, i.r, any_value(i.doc_id) AS doc_id, sum(i.impact)::BIGINT AS score FROM q JOIN i USING (term) GROUP BY q.item_id, i.r),
o AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM d WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM o WHERE rank <= 10
"""
