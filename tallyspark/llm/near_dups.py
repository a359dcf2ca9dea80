"""Near-duplicate documents by Order MinHash and banded alignment.

Sketch: of a text's five-word k-mers, each labelled with its occurrence number, every one of ``SAMPLES`` keyed
hashes samples the one that it makes least; the sketch keeps the samples with their order in the text. A key is
two neighbouring samples in their text order, so texts that share a key share two k-mers in one order. Scattered
word changes at the word edit similarity s leave s^5 of the k-mers, so J = s^5 / (2 - s^5) of the samples agree, and
a pair shares a key with ``meeting_probability(s)``: 0.93 at s = 0.8, over 0.99 at 0.85. Few words make few five-word k-mers, and a few changes can break
them all, so texts of fewer than ``SHORT`` words are sketched by ``SHORT_K``-word k-mers; those that a longer text can be
similar to have both sketches. Changes that break all k-mers (every fifth word of a long text) aren't found.

Copies: texts with equal digests are one node, so a group of copies is one row from there on.

Buckets: the nodes with one key. First, every node meets the node that leads most of its buckets (the least), and, if it is
in a bucket of more than ``MOST`` nodes, the hub of the largest (the node in most such buckets). Links that alignment
confirms make components. Then, in each bucket of up to ``MOST`` nodes, all nodes of different components meet.

Larger buckets come from passages that very many texts share, and from very large groups of near copies. Texts with more than
``CROWDED`` keys in such buckets are sketched again, by the k-mers that their hub does not have: what they share with
another text beside the passage. As that is little and rare, each of the ``SAMPLES`` least is a key by itself. That is done
``ROUNDS`` times.

The rest of larger buckets is exact: all texts of such buckets that have the words in common that a link needs, and are not in one
component yet, are aligned (``_rare``, ``_across``). Words that very many texts share don't bring texts together unless they are more
than ``threshold`` of them. Similar texts stand side by side in blocks, and a rare word joins the blocks that have it, not their texts:
the rows grow with the square of a group's blocks. Inside a pair of blocks, arrays count the words in common, and texts that share
enough are aligned where both blocks are, until their components are linked; only links leave it. With ``exhaustive``, all nodes of
different components in buckets of any size meet instead, without regard to their rare words.

Before texts are fetched for an alignment in a smaller bucket, ``PARITY`` bits of each tell most pairs apart that lack the words in common that
a link needs: an edit changes few of them, so no link is lost.

A pair is linked if its word edit similarity, 1 - distance / words of the longer text, is at least
``threshold`` (0.8).
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import U64, Words, free_name, joined, mix, ranked, rolling, store, table
from .components import components

K = 5
SAMPLES = 80
#: Words of a text from which on five-word k-mers are enough, and the k-mers of shorter texts.
SHORT, SHORT_K = 160, 3
#: Nodes of a bucket in which all meet, and how often texts are sketched again without what their hub has.
MOST, ROUNDS = 64, 2
#: Keys in larger buckets from which a text is sketched again.
CROWDED = SAMPLES // 8
#: Rare words that texts of larger buckets must share to be compared.
COMMON = 4
#: Texts of a block, and bytes of a text (as a power of 2) from which on a block has half as many for each further power.
BLOCK, BLOCK_LONG = 256, 12
#: Pairs of texts of two blocks that a row carries: what a task aligns at once.
STEP_PAIRS = 1 << 13
#: 64-bit words of the parities of a text's words.
PARITY = 4
THRESHOLD = 0.8
#: Rows of the alignment for which a word has one mask.
MASK = 1024
STEP_BYTES = 2 << 20
BITS = [f"bits{k}" for k in range(PARITY)]
#: Numbers of texts whose id is null start here.
NAMELESS = 1 << 62


def meeting_probability(similarity: float, k: int = K) -> float:
    """With scattered word changes, the probability that two texts share a key: that among the samples that agree are
    neighbours on the circle of samples."""
    kept = similarity**k
    j = kept / (2 - kept)
    apart = lambda c: SAMPLES * math.comb(SAMPLES - c, c) // (SAMPLES - c)  # noqa: E731  choices of c samples without neighbours
    return 1 - sum(apart(c) * j**c * (1 - j) ** (SAMPLES - c) for c in range(SAMPLES // 2 + 1))


def kmers(words: Words, k: int = K, some: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers with their occurrence labels, and each text's range of them; of ``some`` texts only, the others have none.

    A text of 1 to k - 1 words has one k-mer, all its words."""
    h, bounds = words.hashes(), words.bounds
    n = np.diff(bounds)
    if some is not None:
        n = np.where(some, n, 0)
    pad = np.zeros(k - 1, U64)
    spread = rolling(np.r_[h, pad], k)[: len(h)]
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    first = np.cumsum(count) - count
    at = np.arange(count.sum()) - np.repeat(first, count) + np.repeat(bounds[:-1], count)
    out = spread[at]
    for d in np.flatnonzero((n > 0) & (n < k)):
        own = h[bounds[d] : bounds[d + 1]]
        out[first[d]] = mix(np.array([sum(int(x) * 3**i for i, x in enumerate(own)) + len(own) & 0xFFFFFFFFFFFFFFFF], U64))[0]
    doc = np.repeat(np.arange(len(n)), count)
    order = np.argsort(out ^ mix(doc.astype(U64)), kind="stable")
    ordered = (out ^ mix(doc.astype(U64)))[order]
    new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(order) else np.empty(0, np.int64)
    label = np.arange(len(order)) - np.repeat(new, np.diff(np.r_[new, len(order)]))
    again = label > 0
    out[order[again]] = mix(out[order[again]] + label[again].astype(U64))
    return out, np.r_[first, count.sum()]


def order_keys(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The keys of texts with these k-mers (texts without: zeros)."""
    docs = np.flatnonzero(np.diff(bounds))
    out = np.zeros((len(bounds) - 1, SAMPLES), U64)
    if not len(docs):
        return out
    first, low = bounds[:-1][docs], U64((1 << 28) - 1)
    place = np.minimum(np.arange(len(values)) - np.repeat(bounds[:-1], np.diff(bounds)), 1 << 28).astype(U64) & low
    found, where = np.empty((SAMPLES, len(docs)), U64), np.empty((SAMPLES, len(docs)), np.int64)
    factors = mix(np.arange(1, SAMPLES + 1, dtype=U64)) | U64(1)
    for k, factor in enumerate(factors):
        least = np.minimum.reduceat((values * factor) & ~low | place, first)
        where[k] = (least & low).astype(np.int64)
        found[k] = values[first + where[k]]
    for k in range(SAMPLES):
        ahead = where[k - 1] <= where[k]
        x, y = np.where(ahead, found[k - 1], found[k]), np.where(ahead, found[k], found[k - 1])
        out[docs, k] = mix(x * U64(0x9E3779B97F4A7C15) + mix(y + U64(k + 1)))
    return out


def distance_within(a: list, b: list, most: int) -> int | None:
    """Word edit distance if it is ``most`` or less: bit-parallel alignment inside a diagonal band.

    Bit k of the state stands for row j + k - most of the column j, so the band slides with the
    columns and holds 2 * most + 1 rows."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    if not b:
        return len(a)
    width = 2 * most + 1
    full, high = (1 << width) - 1, 1 << width - 1
    # column 0: rows 1.. are each one more than the row above; rows up to 0 are none
    vp, vn, score = full ^ ((1 << most) - 1), 0, min(most, len(a))
    both, masks = set(b), {}
    for i, w in enumerate(a):
        if w in both:  # where the word stands, a mask for each run of MASK rows
            own = masks.setdefault(w, {})
            own[i // MASK] = own.get(i // MASK, 0) | 1 << i % MASK
    end = len(a) - 1  # the last row
    for j, w in enumerate(b):
        low = j - most  # the row (from 0) that bit 0 stands for
        x, own = 0, masks.get(w, {})
        near = range(max(low, 0) // MASK, (low + width) // MASK + 1)
        for k in near if len(near) < len(own) else own:
            if k in near and (m := own.get(k)):
                shift = k * MASK - low
                x |= m << shift if shift >= 0 else m >> -shift
        x &= full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        bottom = low + width - 1
        if bottom <= end:  # the band's last cell moves along its diagonal
            score += not d0 & high
        else:
            last = 1 << end - low
            score += bool(hp & last) - bool(hn & last)
        shifted = d0 >> 1
        vp = (hn | ~(shifted | hp)) & full
        vn = shifted & hp
    return score if score <= most else None


def similar(left: bytes, right: bytes, threshold: float) -> bool:
    """Whether word edit similarity reaches the threshold; texts without words are similar to each other."""
    return _similar_words(left.split(), right.split(), threshold)


def _similar_words(a: list, b: list, threshold: float, bags: tuple[Counter, Counter] | None = None) -> bool:
    """``similar`` of two texts' words (and their numbers by word, if known)."""
    longer = max(len(a), len(b))
    most = int((1 - threshold) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    x, y = bags or (Counter(a), Counter(b))
    shared = sum((x & y).values())
    if longer - shared > most:
        return False
    head = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        head += 1
    a, b = a[head:], b[head:]
    tail = 0
    for x, y in zip(reversed(a), reversed(b), strict=False):
        if x != y:
            break
        tail += 1
    if tail:
        a, b = a[:-tail], b[:-tail]
    band = max(8, abs(len(a) - len(b)))
    while True:  # near copies need a narrow band only
        band = min(band, most)
        if distance_within(a, b, band) is not None:
            return True
        if band == most:
            return False
        band *= 4


def _sketches(n: np.ndarray, threshold: float) -> list[tuple[int, np.ndarray]]:
    """The k-mers by which texts of ``n`` words are sketched, so that texts that can be similar have one sketch in common."""
    return [(K, n >= int(SHORT * threshold)), (SHORT_K, n < SHORT)]


def _keys(words: Words, threshold: float) -> pa.Array:
    """The keys of each text's sketches."""
    sketches = _sketches(np.diff(words.bounds), threshold)
    keys = np.hstack([order_keys(*kmers(words, k, has)) ^ U64(k * 0x9E3779B1) for k, has in sketches])
    held = np.repeat(np.array([has for _, has in sketches]).T, SAMPLES, axis=1)
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(held.sum(1))].astype(np.int32)), pa.array(keys[held].view(np.int64)))


def _parities(words: Words) -> np.ndarray:
    """For each text, whether the number of its words with each of 64 * ``PARITY`` hashes is odd, as bits. Texts that differ in as many bits have
    at least as many words that are not in common."""
    n = len(words.bounds) - 1
    out = np.zeros(n * PARITY, U64)
    bit = mix(words.hashes() ^ U64(PARITY)) % U64(64 * PARITY)
    at = np.repeat(np.arange(n), np.diff(words.bounds)) * PARITY + (bit >> U64(6)).astype(np.int64)
    np.bitwise_xor.at(out, at, U64(1) << (bit & U64(63)))
    return out.reshape(n, PARITY)


def _words(text: str | None) -> Words:
    return Words(data=np.frombuffer((text or "").encode(), np.uint8))


def _beside(text: str, hub: str, salt: int, threshold: float) -> np.ndarray:
    """Keys of a text by the k-mers that its hub does not have: for each of its sketches, the ``SAMPLES`` least of their hashes."""
    words, others, out = _words(text), _words(hub), []
    for k, has in _sketches(np.diff(words.bounds), threshold):
        if has[0]:
            values, other = kmers(words, k)[0], kmers(others, k)[0]
            out.append(np.sort(mix(values[~np.isin(values, other)] ^ mix(np.array([salt + 16 * (k != K)], U64))))[:SAMPLES])
    return np.concatenate(out)


def _labelled(text: str | None) -> np.ndarray:
    """Hashes of a text's words, labelled with their occurrence."""
    h = _words(text).hashes()
    order = np.argsort(h, kind="stable")
    ordered = h[order]
    new = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    label = np.arange(len(order)) - np.repeat(new, np.diff(np.r_[new, len(order)]))
    return np.where(label > 0, mix(ordered + label.astype(U64)), ordered).view(np.int64)


def _rare(crowd: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(key, node) by which all texts of ``crowd`` (node) that can be similar meet.

    An edit changes one word, so texts with an edit similarity of ``threshold`` or more have at least that part of the longer one's
    words in common. If each text's words are put in one order, the rarest first, two such texts share ``COMMON`` of the first that
    exceed what may differ by so many (or all they must, if that is less): those are the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch["node"].to_pylist(), batch["text"].to_pylist(), strict=True):
                own = _labelled(text)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.full(len(own), node)), pa.array(np.full(len(own), len(own), np.int32))], ["key", "node", "n"])

    held = store(texts.join(crowd, "node").select("node", "text").mapInArrow(run, "key long, node long, n int"), "words")
    # of words that one text has, only their number counts
    shared = store(held.groupBy("key").agg(F.count(F.lit(1)).alias("df")).filter("df > 1"), "frequent")
    ranked = held.join(shared, "key").withColumn("behind", F.row_number().over(Window.partitionBy("node").orderBy(F.desc("df"), F.desc("key"))))
    return ranked.filter(F.col("behind") > _same(F.col("n"), threshold) - _fewest(F.col("n"), threshold)).select("key", "node")


def _same(n: Column, threshold: float) -> Column:
    """Words that a text of ``n`` words has in common with each that is similar."""
    return F.ceil(threshold * n - 1e-6)


def _fewest(n: Column, threshold: float) -> Column:
    return F.least(_same(n, threshold), F.lit(COMMON))


def _blocks(crowd: DataFrame, texts: DataFrame, sizes: DataFrame, comps: DataFrame) -> DataFrame:
    """(block, at, node, comp, n_words) of the nodes of ``crowd`` (node, main): texts of about one size, one largest bucket and one
    component stand side by side, up to ``BLOCK`` in a block."""
    facts = sizes.join(comps.withColumnRenamed("id", "node"), "node", "left").select("node", "n_words", F.coalesce("component", "node").alias("comp"))
    size = F.floor(F.log2(F.octet_length("text") + 1)).cast("long")
    placed = crowd.join(texts.select("node", size.alias("power")), "node").join(facts, "node")
    width = F.greatest(F.lit(1), F.expr(f"shiftright({BLOCK}, int(greatest(power - {BLOCK_LONG - 1}, 0)))"))
    block = F.shiftleft("power", 48) + F.floor(F.col("rank") / width)
    placed = ranked(placed, "power", "main", "comp", "node").select(block.alias("block"), (F.col("rank") % width).cast("int").alias("at"), "node", "comp", "n_words")
    return store(placed, "blocks")


def _across(rows: DataFrame, blocks: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between the components of ``blocks``: all texts of different components that share as many keys of
    ``rows`` (``_rare``) as they must are aligned, unless their components are linked by others of the two blocks."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in ("comp", "n_words") for f in (F.min, F.max)]
    held = store(rows.join(blocks, "node").groupBy("key", "block").agg(F.collect_list("at").alias("at"), *ends), "held")
    x, y = (held.select("key", *(F.col(c).alias(f"{side}_{c}") for c in held.columns[1:])) for side in "xy")
    several = F.least("x_min_comp", "y_min_comp") < F.greatest("x_max_comp", "y_max_comp")
    near = (F.col("x_max_n_words") >= threshold * F.col("y_min_n_words") - 1e-9) & (F.col("y_max_n_words") >= threshold * F.col("x_min_n_words") - 1e-9)
    met = x.join(y, "key").filter((F.col("x_block") <= F.col("y_block")) & several & near)
    met = met.select("x_block", "y_block", "x_at", "y_at", F.least("x_min_n_words", "y_min_n_words").alias("n"))

    def count(tile: pa.Table) -> pa.Table:
        common = np.zeros((BLOCK, BLOCK), np.int32)
        for p, q in zip(tile["x_at"].to_pylist(), tile["y_at"].to_pylist(), strict=True):
            common[np.ix_(p, q)] += 1
        ids = [tile[c][0].as_py() for c in ("x_block", "y_block")]
        if ids[0] == ids[1]:
            common = np.triu(common, 1)
        fewest = min(COMMON, math.ceil(threshold * min(tile["n"].to_pylist()) - 1e-6))
        p, q = np.nonzero(common >= max(fewest, 1))
        first = np.argsort(-common[p, q], kind="stable")  # the likeliest links
        steps = range(0, len(p), STEP_PAIRS)
        cols = [[i] * len(steps) for i in ids] + [[v[first[k : k + STEP_PAIRS]] for k in steps] for v in (p, q)]
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("x_block", "y_block", "x_at", "y_at"), cols, [pa.int64()] * 2 + [pa.list_(pa.int32())] * 2, strict=True)})

    tiles = store(met.groupBy("x_block", "y_block").applyInArrow(count, "x_block long, y_block long, x_at array<int>, y_at array<int>"), "tiles")
    wanted = tiles.select(F.explode(F.array("x_block", "y_block")).alias("block")).distinct()
    full = blocks.join(wanted, "block", "left_semi").join(texts, "node").groupBy("block").agg(F.collect_list(F.struct("at", "comp", "text")).alias("rows"))
    full = store(full, "full")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = _linked(batch.slice(k, 1).to_pylist()[0], threshold)
                yield pa.RecordBatch.from_arrays([pa.array([v[i] for v in found], pa.int64()) for i in (0, 1)], ["a", "b"])

    for side in "xy":
        tiles = tiles.join(full.select(F.col("block").alias(f"{side}_block"), F.col("rows").alias(f"{side}_rows")), f"{side}_block")
    return tiles.select("x_at", "y_at", "x_rows", "y_rows").mapInArrow(link, "a long, b long").distinct()


def _linked(tile: dict, threshold: float) -> list[tuple[int, int]]:
    """Links between the components of two blocks' texts: their candidates (x_at, y_at) are aligned in that order, but for those whose
    components are linked already."""
    sides = [{r["at"]: r for r in tile[f"{side}_rows"]} for side in "xy"]
    up, links = {}, []

    def top(c: int) -> int:
        while c in up:
            c = up[c]
        return c

    def words(r: dict) -> tuple[list, Counter]:
        if "words" not in r:
            r["words"] = own = (r["text"] or "").encode().split()
            r["bag"] = Counter(own)
        return r["words"], r["bag"]

    for p, q in zip(tile["x_at"], tile["y_at"], strict=True):
        x, y = sides[0][p], sides[1][q]
        c, d = top(x["comp"]), top(y["comp"])
        if c != d:
            (a, bag), (b, other) = words(x), words(y)
            if _similar_words(a, b, threshold, (bag, other)):
                links.append((x["comp"], y["comp"]))
                up[max(c, d)] = min(c, d)
    return links


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
    return pairs.join(right, "b").join(left, "a")


def _alike(batch: pa.RecordBatch, threshold: float) -> list[bool]:
    texts = zip(batch["ta"].to_pylist(), batch["tb"].to_pylist(), strict=True)
    return [similar((x or "").encode(), (y or "").encode(), threshold) for x, y in texts]


def _confirm(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The components (ca, cb) of those pairs (a, b, ca, cb) whose texts align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["ca"], batch["cb"]], ["a", "b"]).filter(pa.array(_alike(batch, threshold), pa.bool_()))

    return _with_texts(pairs, texts).select("ca", "cb", "ta", "tb").mapInArrow(run, "a long, b long")


def _led(pairs: DataFrame, texts: DataFrame, threshold: float, salt: int) -> DataFrame:
    """Of pairs (a, b, beside) of leads or hubs and nodes: whether they align and, where ``beside`` asks for it,
    the node's keys beside its hub (none with salt 0)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = _alike(batch, threshold)
            rows = zip(batch["beside"].to_pylist(), batch["tb"].to_pylist(), batch["ta"].to_pylist(), strict=True)
            keys = [_beside(node or "", hub or "", salt, threshold).view(np.int64) if asked and salt else None for asked, node, hub in rows]
            cols = [batch["a"], batch["b"], pa.array(ok, pa.bool_()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, ["a", "b", "ok", "keys"]).filter(pa.array([x or y is not None for x, y in zip(ok, keys, strict=True)], pa.bool_()))

    return store(_with_texts(pairs, texts).mapInArrow(run, "a long, b long, ok boolean, keys array<long>"), "led")


def _buckets(keyed: DataFrame) -> DataFrame:
    """(key, node, size, lead) of the nodes (node, keys) that share a key with others."""
    flat = keyed.select(F.explode("keys").alias("key"), "node")
    shared = flat.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("lead")).filter("size > 1")
    # as a table, so that the join can split a key with very many nodes
    return store(flat.join(store(shared, "shared"), "key"), "buckets")


def _first_pairs(buckets: DataFrame, most: int) -> DataFrame:
    """(a, b, beside): each node b with the lead of most of its buckets, and with the hub of its largest bucket."""
    large = F.col("size") > most
    lead = F.mode(F.expr("IF(lead < node, lead, NULL)"), True).alias("lead")
    facts = store(buckets.groupBy("node").agg(lead, F.count_if(large).alias("hot"), F.max_by("key", F.when(large, F.struct("size", "key"))).alias("main")), "facts")
    crowded = facts.filter("hot > 0")
    hubs = crowded.groupBy("main").agg(F.max(F.struct("hot", (-F.col("node")).alias("minus"))).alias("hub")).select("main", (-F.col("hub.minus")).alias("a"))
    hubs = store(hubs, "hubs")
    hubs = crowded.join(hubs, "main").filter("a <> node").select("a", F.col("node").alias("b"), (F.col("hot") > CROWDED).alias("beside"))
    leads = facts.filter("lead < node").select(F.col("lead").alias("a"), F.col("node").alias("b"), F.lit(False).alias("beside"))
    return leads.unionByName(hubs).groupBy("a", "b").agg(F.max("beside").alias("beside"))


def _meetings(rows: DataFrame, sizes: DataFrame, comps: DataFrame, threshold: float) -> DataFrame:
    """(a, b, ca, cb): pairs of rows (key, node) of one bucket and different components whose lengths allow a link."""
    facts = sizes.join(comps.withColumnRenamed("id", "node"), "node", "left").select("node", "n_words", F.coalesce("component", "node").alias("comp"), *BITS)
    placed = rows.join(facts, "node")
    several = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low < high").select("key")
    placed = store(placed.join(several, "key"), "mixed")
    other = placed.select("key", F.col("node").alias("b"), F.col("comp").alias("cb"), F.col("n_words").alias("nb"), *(F.col(c).alias(f"{c}_b") for c in BITS))
    pairs = placed.select("key", F.col("node").alias("a"), F.col("comp").alias("ca"), F.col("n_words").alias("na"), *BITS).join(other, "key")
    near = F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9
    # words that one of the two has more of: at least as many as parities that differ
    apart = reduce(lambda x, y: x + y, (F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_b"))) for c in BITS))
    near &= apart <= F.col("na") + F.col("nb") - 2 * _same(F.greatest("na", "nb"), threshold)
    return pairs.filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near).select("a", "b", "ca", "cb").distinct()


def _merged(comps: DataFrame, more: DataFrame) -> DataFrame:
    """``comps`` after links between components."""
    up = more.select(F.col("id").alias("component"), F.col("component").alias("new"))
    moved = comps.join(up, "component", "left").select("id", F.coalesce("new", "component").alias("component"))
    return moved.unionByName(more).distinct()


def _classes(docs: DataFrame, threshold: float, id_col: str, text_col: str, exhaustive: bool) -> DataFrame:
    """(id, digest, class) of every text: ids are never null here, and of rows that share one, the least digest counts."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    src = docs.select(_numbered(id_col, text_col).alias("id"), digest.alias("digest"), text.alias("text"))
    most = (1 << 62) if exhaustive else MOST

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(batches, limit=STEP_BYTES):
            words = Words(batch["text"])
            n = np.diff(words.bounds).astype(np.int32)
            bits = [pa.array(c) for c in _parities(words).view(np.int64).T]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["digest"], pa.array(n), _keys(words, threshold), *bits], ["id", "digest", "n_words", "keys", *BITS])

    rows = store(src.mapInArrow(sketched, "id long, digest binary, n_words int, keys array<long>" + "".join(f", {c} long" for c in BITS)), "sketches")
    ids = store(rows.groupBy("id").agg(F.min("digest").alias("digest")), "ids")
    # of texts with copies, the least id is the node; a table, so that the join below can split a text with very many
    copied = store(ids.groupBy("digest").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"), "copied")
    members = store(ids.join(copied, "digest", "left").select("id", "digest", F.coalesce("node", "id").alias("node")), "members")
    firsts = members.filter("id = node").select("id", "digest")
    nodes = rows.join(firsts, ["id", "digest"], "left_semi").filter("n_words > 0")
    nodes = nodes.select(F.col("id").alias("node"), "n_words", "keys", *BITS).dropDuplicates(["node"])

    buckets = _buckets(nodes.select("node", "keys"))
    wanted = firsts.join(buckets.select(F.col("node").alias("id")).distinct(), "id")
    texts = store(src.join(wanted, ["id", "digest"]).select(F.col("id").alias("node"), "text").dropDuplicates(["node"]), "texts")
    crowd = store(buckets.filter(F.col("size") > most).groupBy("node").agg(F.max_by("key", F.struct("size", "key")).alias("main")), "crowd")
    links, small = [], []
    for salt in range(1, ROUNDS + 2):
        small.append(buckets.filter(F.col("size") <= most).select("key", "node"))
        led = _led(_first_pairs(buckets, most), texts, threshold, salt if salt <= ROUNDS else 0)
        links.append(led.filter("ok").select("a", "b"))
        again = led.filter("keys IS NOT NULL")
        if again.isEmpty():
            break
        buckets = _buckets(again.select(F.col("b").alias("node"), "keys"))
    comps = components(reduce(DataFrame.unionByName, links))
    sizes = nodes.select("node", "n_words", *BITS)
    links = _confirm(_meetings(reduce(DataFrame.unionByName, small), sizes, comps, threshold), texts, threshold)
    if not crowd.isEmpty():
        links = links.unionByName(_across(_rare(crowd, texts, threshold), _blocks(crowd, texts, sizes, comps), texts, threshold))
    more = components(links)
    comps = _merged(comps, more)
    out = members.join(comps.withColumnRenamed("id", "node"), "node", "left")
    return out.select("id", "digest", F.coalesce("component", "node").alias("class"))


def _numbered(id_col: str, text_col: str):
    """The id, or, where it is null, a number of its own for each text."""
    own = F.lit(NAMELESS) + F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 2)
    return F.coalesce(F.col(id_col).cast("long"), own)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", exhaustive: bool = False) -> DataFrame:
    """(id, class_id, kept): each document's class, the least id that links reach, and whether it is that document.

    Ids are longs below ``NAMELESS``. Rows that share an id are one document, and if their texts differ, the one with the
    least digest counts. Each text whose id is null is a document of its own, which stands behind all others in its class and
    is shown with null ids. Null and empty texts, and texts without a word, have no k-mers and link only with equal texts
    of their kind (null counts as empty). Very long texts are sketched as a whole. Other columns, whatever their names,
    are not read. An empty table gives an empty table.
    """
    out = _classes(docs, threshold, id_col, text_col, exhaustive)
    shown = lambda c: F.when(F.col(c) < NAMELESS, F.col(c))
    return out.select(shown("id").alias(id_col), shown("class").alias("class_id"), (F.col("id") == F.col("class")).alias("kept"))


def keep_first(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", exhaustive: bool = False) -> DataFrame:
    """The documents that are the first of their class, with all their columns. Of rows that share an id, and of null ids with
    equal texts, one stays; of rows of one id, those with the least digest are read."""
    kept = _classes(docs, threshold, id_col, text_col, exhaustive).filter("id = class")
    own, name = free_name("number", docs), free_name("sha", docs)
    rows = docs.withColumn(own, _numbered(id_col, text_col)).withColumn(name, F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    return rows.join(kept.select(F.col("id").alias(own), F.col("digest").alias(name)), [own, name], "left_semi").dropDuplicates([own]).select(*(f"`{c}`" for c in docs.columns))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
