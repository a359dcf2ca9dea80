"""Removal of long byte strings that occur more than once, by two-stage suffix sorting.

A window is ``WINDOW`` consecutive bytes of one text. Consecutive windows with the same minimiser (the
leftmost least hash among their ``GRAM``-byte grams) are a segment; equal windows have equal minimisers
at the same offset, so they lie in segments of the same fingerprint, and no two windows of one segment
are equal. Segments first travel as fingerprint and digest only:

* segments with equal digests are copies, and all their windows repeat;
* a fingerprint with one kind of segment has no other repeats;
* of the rest, windows that begin up to ``HALF`` bytes before the minimiser share ``CONTEXT`` bytes behind it,
  the others as many before it. A half whose context recurs in another kind is fetched once for each kind
  and sent to the bucket of its fingerprint and context.

A bucket's strings are one text with separators. Its suffix array is built in two stages: the suffixes
smaller than their successors are sorted directly (to ``WINDOW`` bytes), the rest is induced from them
by one scan over the buckets of first bytes. Neighbours with a common prefix of ``WINDOW`` bytes repeat.

A fingerprint with more than ``HOT_KINDS`` kinds (the rim of a passage that very many documents share) would
fill a bucket by itself. Its strings are cut anew, in parts of ``PARTS`` windows by their offset from the
minimiser; all windows of a part share nearly all their bytes, which are the part's fingerprint. Parts
are told apart as segments are, and those that recur in other forms are sorted; what is hot even then is cut in
single windows, which have no other form.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LEAST_ID, U64, joined, mix, rolling, sliding_min, store, table, text_bytes

WINDOW, GRAM = 400, 32
#: Bytes before the minimiser up to which a window belongs to the first half of its segment, and grams of context.
HALF, CONTEXT = (WINDOW - GRAM) // 2, 5 * GRAM
#: Bytes of text for a step, bytes of strings for a bucket, and kinds from which a fingerprint is cut anew (so many
#: strings fit in a bucket).
STEP_BYTES, BUCKET_BYTES, HOT_KINDS = 2 << 20, 1 << 19, 512
#: Kinds that are broadcast at most, and places from which a kind may be.
HOT_MOST, LEAST_HOT = 20_000, 1000
#: Suffixes whose keys are in memory at once, about.
SORT_STEP = 20_000
#: Windows of a part when a hot fingerprint is cut for the first and for the second time.
PARTS = (16, 1)

_SPREAD = mix(np.arange(1, 257, dtype=U64))


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each segment of texts with these bytes: its text, first byte in all, number of windows, minimiser's
    place in all, fingerprint, and the contexts behind and before the minimiser (0 where no window has them)."""
    n = np.maximum(np.diff(offsets) - WINDOW + 1, 0)
    text = np.repeat(np.arange(len(n), dtype=np.int32), n)
    if not len(text):
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, U64),) * 3
    at = np.arange(len(text)) + (offsets[:-1] - np.cumsum(n) + n)[text]
    grams = rolling(_SPREAD[data], GRAM)
    low = U64(0x0FFFFFFF)
    least = (sliding_min((grams & ~low) | np.arange(len(grams), dtype=U64), WINDOW - GRAM + 1) & low)[at].astype(np.int64)
    first = np.flatnonzero(np.r_[True, (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1)])
    size, mark, begin = np.diff(np.r_[first, len(at)]), least[first], at[first]
    behind, before = mix(grams[mark] + U64(1)), mix(grams[mark] + U64(2))
    for k in range(1, CONTEXT // GRAM + 1):
        behind += grams[np.minimum(mark + k * GRAM, len(grams) - 1)] * U64(2 * k + 1)
        before += grams[np.maximum(mark - k * GRAM, 0)] * U64(2 * k + 1)
    behind[begin + size - 1 < mark - HALF] = 0
    before[begin >= mark - HALF] = 0
    return text[first], begin, size, mark, grams[mark], behind, before


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, int]]:
    """Rows with their bytes, each text's range of them, and the place of the first byte: a long text comes in slices
    that overlap so that each window is in one of them."""
    for batch in joined(batches, limit=STEP_BYTES):
        data, offsets = text_bytes(batch["text"])
        if batch.num_rows > 1 or len(data) < 2 * STEP_BYTES:
            yield batch, data, offsets, 0
            continue
        for at in range(0, len(data) - WINDOW + 1, STEP_BYTES):
            part = data[at : at + STEP_BYTES + WINDOW - 1]
            yield batch, part, np.array([0, len(part)]), at


LISTED = "print long, kind long, n long, id long, digest long, start int, size int, mark int"


def _list_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets, skipped in _steps(batches):
        text, begin, size, mark, print_, behind, before = segments(data, offsets)
        raw = data.tobytes()
        kinds = np.frombuffer(b"".join([hashlib.blake2b(raw[a:b], digest_size=8).digest() for a, b in zip(begin.tolist(), (begin + size + WINDOW - 1).tolist(), strict=True)]), np.int64)
        take, own = pa.array(text), skipped - offsets[:-1][text]
        contexts = [pa.array(x.view(np.int64), mask=x == 0) for x in (behind, before)]
        cols = [pa.array(print_.view(np.int64)), pa.array(kinds), pa.array(np.ones(len(text), np.int64)), batch["id"].take(take), batch["digest"].take(take)]
        cols += [pa.array(x.astype(np.int32)) for x in (begin + own, size, mark + own)]
        yield pa.RecordBatch.from_arrays([*cols, *contexts], ["print", "kind", "n", "id", "digest", "start", "size", "mark", "behind", "before"])


def _sorted(t: np.ndarray, some: np.ndarray) -> np.ndarray:
    """These suffixes of ``t`` in order of their first ``WINDOW`` bytes: by the first eight as numbers, then, of those
    that agree in them, by the rest; about ``SORT_STEP`` at a time, so that few keys are in memory."""
    data = t.tobytes()
    heads = np.ndarray(len(t), ">u8", data + bytes(8), strides=(1,))[some].astype(U64)
    order = np.argsort(heads, kind="stable")
    some, heads = some[order], heads[order]
    same = heads[1:] == heads[:-1]
    tied = np.flatnonzero(np.r_[False, same] | np.r_[same, False])
    if not len(tied):
        return some
    first = np.flatnonzero(np.r_[True, heads[tied][1:] != heads[tied][:-1]])
    cuts = [*first[np.unique(np.searchsorted(first, np.arange(0, len(tied), SORT_STEP)))[:-1]].tolist(), len(tied)] if len(tied) > SORT_STEP else [0, len(tied)]
    places = some[tied]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        places[a:b] = sorted(places[a:b].tolist(), key=lambda i: data[i : i + WINDOW])
    some[tied] = places
    return some


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Start positions of all suffixes of ``t`` in order, as far as their first ``WINDOW`` bytes tell.

    ``t`` holds bytes from 1; 0 separates texts and ends the last. Order behind a separator isn't kept."""
    n = len(t)
    change = np.empty(n, bool)
    change[-1] = True
    change[:-1] = t[1:] != t[:-1]
    where = np.where(change, np.arange(n), n)
    where = np.minimum.accumulate(where[::-1])[::-1]  # the end of each run of one byte
    smaller = np.zeros(n, bool)  # than its successor
    inner = where < n - 1
    smaller[inner] = t[where[inner]] < t[where[inner] + 1]

    direct = _sorted(t, np.flatnonzero(smaller & (t > 0)))
    marks = np.flatnonzero(smaller & (t == 0))
    cuts = np.searchsorted(t[direct], np.arange(257))

    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[0].append(np.array([n - 1]))
    out = []
    for c in range(256):
        wave = np.concatenate([np.empty(0, np.int64), *waiting[c]])
        full = [wave]
        while len(wave):  # runs of c induce each other
            wave = wave[wave > 0] - 1
            wave = wave[(t[wave] == c) & ~smaller[wave]]
            full.append(wave)
        here = np.concatenate([*full, marks if c == 0 else direct[cuts[c] : cuts[c + 1]]])
        out.append(here)
        before = here[here > 0] - 1
        before = before[~smaller[before] & (t[before] > c)]
        before = before[np.argsort(t[before], kind="stable")]
        ends = np.searchsorted(t[before], np.arange(257))
        for d in np.flatnonzero(np.diff(ends)):
            waiting[d].append(before[ends[d] : ends[d + 1]])
    return np.concatenate(out)


def common_prefixes(t: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """How many bytes, up to ``most``, each suffix in ``order`` shares with the next one."""
    padded = np.r_[t, np.zeros(8, np.uint8)]
    words = np.ndarray(len(t) + 1, "<u8", padded.tobytes(), strides=(1,))
    out = np.zeros(max(len(order) - 1, 0), np.int64)
    alive = np.arange(len(out))
    for step in range(0, most, 8):
        i, j = order[alive] + step, order[alive + 1] + step
        inside = (i < len(t)) & (j < len(t))
        alive, i, j = alive[inside], i[inside], j[inside]
        apart = words[i] ^ words[j]
        low = apart & (~apart + U64(1))  # the lowest bit that differs
        out[alive] += np.where(apart == 0, 8, np.log2(np.maximum(low, U64(1)).astype(np.float64)).astype(np.int64) // 8)
        alive = alive[apart == 0]
    return np.minimum(out, most)


def repeats(strings: list[bytes]) -> list[np.ndarray]:
    """Of each string, the starts of the windows that occur elsewhere in these strings."""
    t = np.frombuffer(b"\xff".join([*strings, b""]), np.uint8) + np.uint8(1)  # UTF-8 has no byte ff, which becomes 0
    sizes = np.array([len(s) + 1 for s in strings])
    ends = np.cumsum(sizes)
    room = np.repeat(ends - 1, sizes) - np.arange(len(t))
    order = suffix_array(t)
    order = order[room[order] >= WINDOW]
    again = common_prefixes(t, order, WINDOW) >= WINDOW
    hit = np.zeros(len(t), bool)
    hit[order[:-1][again]] = True
    hit[order[1:][again]] = True
    found = np.flatnonzero(hit)
    cut = np.searchsorted(found, np.r_[0, ends])
    return [found[a:b] - (e - s) for a, b, e, s in zip(cut[:-1], cut[1:], ends, sizes, strict=True)]


RUNS = "id long, digest long, start int, size int"


def _runs(ids, digests, starts: list[np.ndarray]) -> pa.Table:
    """Runs of consecutive windows."""
    rows: list[list] = [[], [], [], []]
    for i, d, s in zip(ids, digests, starts, strict=True):
        if len(s):
            first = np.flatnonzero(np.r_[True, np.diff(s) != 1])
            rows[0] += [i] * len(first)
            rows[1] += [d] * len(first)
            rows[2] += s[first].tolist()
            rows[3] += np.diff(np.r_[first, len(s)]).tolist()
    return pa.table([pa.array(r, k) for r, k in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], ["id", "digest", "start", "size"])


def _sort(group: pa.Table) -> pa.Table:
    """Repeated windows of the single strings of a bucket; strings of several fingerprints are sorted together."""
    rows = group.to_pylist()
    found = repeats([r["bytes"] for r in rows])
    some = [k for k, r in enumerate(rows) if r["n"] == 1]
    return _runs([rows[k]["id"] for k in some], [rows[k]["digest"] for k in some], [found[k] + rows[k]["start"] for k in some])


def _asked(src: DataFrame, asked: DataFrame) -> DataFrame:
    """Texts (id, digest, text) with the strings that are asked of each, as a table."""
    ask = F.struct("print", "kind", "n", "start", "size", "mark", "hot")
    asks = asked.groupBy("id", "digest").agg(F.collect_list(ask).alias("asks"), F.max("hot").alias("hot"))
    # repeated rows are fetched once: the join has them in order already
    return store(src.join(asks, ["id", "digest"]).select("id", "digest", "text", "asks", "hot").dropDuplicates(["id", "digest"]), "asked")


def _each_ask(batches: Iterator[pa.RecordBatch], hot: bool) -> Iterator[Iterator[tuple[int, int, bytes, dict]]]:
    for batch in joined(batches, limit=STEP_BYTES):
        texts = zip(*(batch[c].to_pylist() for c in ("id", "digest", "text", "asks")), strict=True)
        yield ((i, d, raw, q) for i, d, text, wanted in texts for raw in (text.encode(),) for q in wanted if q["hot"] == hot)


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The strings of fingerprints that aren't hot."""
    for asks in _each_ask(batches, False):
        rows = [(q["print"], q["kind"], q["n"], i, d, q["start"], raw[q["start"] : q["start"] + q["size"] + WINDOW - 1]) for i, d, raw, q in asks]
        types = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], ["print", "kind", "n", "id", "digest", "start", "bytes"])


def _cut(width: int):
    """Parts of ``width`` windows of the strings of hot fingerprints, as segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for asks in _each_ask(batches, True):
            rows = []
            for i, d, raw, q in asks:
                mark, last = q["mark"], q["start"] + q["size"] - 1
                for k in range((mark - last) // width, (mark - q["start"]) // width + 1):
                    a, b = max(q["start"], mark - k * width - width + 1), min(last, mark - k * width)
                    core = mark - k * width  # all windows of the part have the bytes from here on
                    part = hashlib.blake2b(raw[core : core + WINDOW + 1 - width], digest_size=8, salt=q["print"].to_bytes(8, "little", signed=True), person=k.to_bytes(8, "little")).digest()
                    form = hashlib.blake2b(raw[a : b + WINDOW], digest_size=8).digest()
                    rows.append((int.from_bytes(part, "little", signed=True), int.from_bytes(form, "little", signed=True), q["n"], i, d, a, b - a + 1, mark))
            types = [pa.int64()] * 5 + [pa.int32()] * 3
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], [c.split()[0] for c in LISTED.split(", ")])

    return run


def _forms(listed: DataFrame, *more: str) -> DataFrame:
    """One row for each kind of each fingerprint: how often it comes and one place of it."""
    of = F.min(F.struct("id", "digest", "start", "size", "mark")).alias("of")
    return listed.groupBy("print", "kind").agg(F.sum("n").alias("n"), of, *(F.min(c).alias(c) for c in more))


def _several(forms: DataFrame) -> DataFrame:
    """The kinds of fingerprints that have several, with their number."""
    return forms.join(forms.groupBy("print").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1"), "print")


def _copies(listed: DataFrame, forms: DataFrame) -> DataFrame:
    """The places of kinds that come more than once. Kinds with so many places that there can be ``HOT_MOST`` of them at most are
    broadcast, so their places stay where they are; the others' meet by a shuffle, in which none is large."""
    key, place = ["print", "kind"], ["id", "digest", "start", "size"]
    several = forms.filter("n > 1").select(*key, "n")
    hot = F.col("n") >= max(LEAST_HOT, listed.count() // HOT_MOST)
    crowded = F.broadcast(several.filter(hot).select(*key))
    usual = listed.join(crowded, key, "left_anti").join(several.filter(~hot).select(*key), key, "left_semi")
    return listed.join(crowded, key, "left_semi").select(*place).unionByName(usual.select(*place))


def _settled(parts: DataFrame, src: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """Repeated windows of parts (``LISTED``, one row for each kind) that have equal windows in other kinds."""
    asked = store(_several(parts).withColumn("hot", F.col("kinds") > (HOT_KINDS if widths else (1 << 62))), "several")
    volume = asked.agg(F.sum(F.when(~F.col("hot"), F.col("size") + WINDOW - 1)).alias("cold"), F.max("hot").alias("hot")).first()
    buckets = max(1, -(-(volume["cold"] or 0) // BUCKET_BYTES))
    texts = _asked(src, asked)
    strings = texts.select("id", "digest", "text", "asks").mapInArrow(_fetch, "print long, kind long, n long, id long, digest long, start int, bytes binary")
    out = strings.withColumn("bucket", F.pmod("print", F.lit(buckets))).groupBy("bucket").applyInArrow(_sort, RUNS)
    if volume["hot"]:
        crowded = texts.filter("hot")
        listed = store(crowded.select("id", "digest", "text", "asks").mapInArrow(_cut(widths[0]), LISTED).distinct(), "parts")
        forms = store(_forms(listed), "forms")
        out = out.unionByName(_copies(listed, forms)).unionByName(_settled(forms.select("print", "kind", "n", "of.*"), crowded.select("id", "digest", "text"), widths[1:]))
    return out


def repeated_bytes(src: DataFrame) -> DataFrame:
    """Runs (id, digest, start, size) of windows that occur elsewhere, for ``src`` (id, digest, text)."""
    listed = store(src.mapInArrow(_list_segments, LISTED + ", behind long, before long"), "segments")
    forms = _forms(listed, "behind", "before")
    forms = store(forms.join(forms.groupBy("print").agg(F.count(F.lit(1)).alias("kinds")), "print").filter("n > 1 OR kinds > 1"), "forms")
    turn = F.greatest(F.col("of.start"), F.col("of.mark") - HALF)  # the first window of the first half
    end = F.col("of.start") + F.col("of.size")
    half = lambda context, start, stop: F.struct(F.col(context).alias("print"), start.alias("start"), (stop - start).cast("int").alias("size"))
    halves = F.explode(F.array(half("behind", turn, end), half("before", F.col("of.start"), F.least(end, F.col("of.mark") - HALF)))).alias("half")
    parts = forms.filter("kinds > 1").select("kind", "n", "of.id", "of.digest", "of.mark", halves).filter("half.print IS NOT NULL")
    parts = parts.select("half.print", "kind", "n", "id", "digest", "half.start", "half.size", "mark")
    return _copies(listed, forms).unionByName(_settled(parts, src, PARTS))


def dedup_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row of ``docs``: bytes that a window
    covers which also starts elsewhere (in this text or another) are removed.

    Ids are longs; a null one counts as the least long. Null counts as empty; texts of fewer than ``WINDOW`` bytes
    lose nothing. Very long texts are taken in slices, of any length that a string may have. Every row is a text of
    its own, so a repeated row repeats itself and loses all its bytes; its runs are found and kept once, whatever its repetitions. Other columns, whatever their names, are not read. An empty table
    gives an empty table.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LEAST_ID)).alias("id"), F.xxhash64(text).alias("digest"), text.alias("text"))
    # a set: repeated rows find the same runs, each of them
    runs = repeated_bytes(src).groupBy("id", "digest").agg(F.collect_set(F.struct("start", "size")).alias("runs"))
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if kept_bytes else [])]

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches):
            out = []
            for text, found in zip(batch["text"].to_pylist(), batch["runs"].to_pylist(), strict=True):
                raw, kept, gone, spans, end = text.encode(), [], 0, 0, 0
                for a, b in sorted((r["start"], r["start"] + r["size"] + WINDOW - 1) for r in found or ()):
                    if a > end or not spans:
                        kept.append(raw[end:a])
                        spans += 1
                        end = a
                    gone += max(0, b - end)
                    end = max(end, b)
                kept = b"".join([*kept, raw[end:]])
                out.append((len(raw), gone, spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out, strict=True))[: 4 + kept_bytes]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch["id"], *(pa.array(c, k) for c, k in zip(cols, kinds, strict=False))], names)

    found = src.join(runs, ["id", "digest"], "left").select("id", "text", "runs")
    out = found.mapInArrow(finish, f"`{id_col}` long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * kept_bytes)
    return out.withColumn(id_col, F.nullif(id_col, F.lit(LEAST_ID)))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.withColumn("has_repeats", F.col("n_removed") > 0)
