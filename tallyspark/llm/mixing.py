"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Documents fall by a keyed hash into ``blocks`` blocks of their source (1,024, and more in a large corpus), so a
   block's documents are dealt out together and a hot source is as many groups as any other.
2. Each source's target is water-filled under its cap (``max_epochs`` times its size).
3. Per source (at most ``blocks`` rows each), full passes over all blocks and one permuted partial
   pass make an exact quota of block draws; a block is drawn ``max_epochs`` times at most.
4. The quotas of all sources are split down a tree of output shards: a node hands each child its
   share of slots, drawn from the node's quotas multivariate-hypergeometrically, so every shard has
   its exact number of draws and all assignments are equally likely.
5. A shard's quota of a source is a run of that source's permuted draws, disjoint from all others;
   rows are shuffled inside their shard by a keyed hash.

Everything is seeded by document ids and names, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, ranked, store, table

FAN_OUT = 8
#: Blocks that a source has at most, and words that a block and a shard are meant to hold in a large corpus.
SLOTS, BLOCK_WORDS, SHARD_WORDS = 1 << 20, 1 << 20, 1 << 25


def water_filled(sources: DataFrame, budget: float, total: float) -> DataFrame:
    """``sources`` (with ``weight`` and ``cap``) with ``target``: shares of the budget by weight, where
    whatever is above a cap is shared again by weight. Each round is one small aggregation."""
    level, held = None, -1
    while True:
        capped = F.col("cap") <= F.lit(level) * F.col("weight") if level is not None else F.lit(False)
        row = sources.agg(
            F.sum(F.when(capped, F.col("cap")).otherwise(0.0)).alias("cap"),
            F.sum(F.when(capped, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.sum(F.when(capped, 1).otherwise(0)).alias("n"),
        ).first()
        if row["n"] is None or row["n"] == held or not row["free"]:
            break
        held, level = row["n"], (budget * total - row["cap"]) / row["free"]
    return sources.withColumn("target", F.least(F.col("cap"), F.lit(level or 0.0) * F.col("weight")))


def _seed(*parts: int) -> np.random.Generator:
    return np.random.Generator(np.random.PCG64(np.random.SeedSequence(list(parts))))


def _quota(seed: int, max_epochs: int):
    """The draws of one source: (block, epoch) at positions 0, 1, ... in permuted order."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ignore_index=True)
        rank, target, words = int(rows["rank"][0]), float(rows["target"][0]), rows["words"].to_numpy(np.int64)
        size, draws = int(words.sum()), []
        full = 0 if size == 0 else min(max_epochs, int(target // size))
        for epoch in range(full):
            draws += [(b, epoch) for b in _seed(seed, rank, epoch).permutation(len(rows))]
        rest = target - full * size
        if size and full < max_epochs and rest > 0:
            order = _seed(seed, rank, full).permutation(len(rows))
            left = []
            for b in order:  # what fits, in permuted order
                if words[b] <= rest:
                    draws.append((b, full))
                    rest -= words[b]
                else:
                    left.append(b)
            if left and abs(words[least := min(left, key=lambda b: (words[b], b))] - rest) < rest:
                draws.append((least, full))
        at = np.array([b for b, _ in draws], np.int64)
        return pd.DataFrame({"rank": rank, "place": np.arange(len(draws)), "block": rows["block"].to_numpy()[at] if len(at) else at, "epoch": [e for _, e in draws]}).astype({"epoch": "int32"})

    return run


def _split(seed: int, width: int, shards: int, slots: int):
    """Hand a node's quotas to its children. A node is its first shard; it spans ``width`` shards."""
    before = lambda shard: slots * min(shard, shards) // shards

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rank", ignore_index=True)
        node, left = int(rows["shard"][0]), rows["quota"].to_numpy(np.int64).copy()
        rng, step, out = _seed(seed, node, width), width // FAN_OUT, []
        for child in range(node, min(node + width, shards), step):
            room = before(child + step) - before(child)
            drawn = rng.multivariate_hypergeometric(left, room, method="marginals") if len(left) > 1 else np.array([room])
            left = left - drawn
            some = drawn > 0
            out.append(pd.DataFrame({"shard": child, "rank": rows["rank"].to_numpy()[some], "quota": drawn[some]}))
        return pd.concat(out).astype("int64")

    return run


class Mix:
    """The mix of one corpus. ``sized``: id, source, size and block of every document; ``sources``: one
    row for each source with rank, weight, size, cap and target; ``draws``: (source, block, epoch, shard).

    A null source is a source of its own, after all others; null and empty texts have size 0 and, like
    sources of size 0, are never drawn for words but travel with their block. Repeated rows count each and are
    drawn together; rows without id are dealt by their texts, and equal ones of them are drawn together. A very long text is drawn whole or not, and a target is met as nearly as
    the blocks allow. The id, source and text columns are read and nothing else; ``names`` has those of shard, epoch
    and order, with underscores behind them where the documents have such columns. An empty table gives empty ones.
    """

    def __init__(self, docs: DataFrame, weights: Sequence[float] = (3, 1, 2), budget: float = 1.5, max_epochs: int = 2, shards: int | None = None, blocks: int | None = None, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text"):
        self.id_col, self.source_col, self.text_col, self.docs = id_col, source_col, text_col, docs
        self.names = tuple(free_name(n, docs) for n in ("shard", "epoch", "order"))
        size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
        self.slot = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col))), F.lit(SLOTS)).cast("int")
        sized = store(docs.select(F.col(id_col), F.col(source_col).alias("source"), size.alias("size"), self.slot.alias("slot")), "sized")
        per_slot = sized.groupBy("source", "slot").agg(F.sum("size").alias("words"))
        if blocks is None or shards is None:
            most, every = sized.groupBy("source").agg(F.sum("size").alias("n")).agg(F.max("n"), F.sum("n")).first()
            blocks = blocks or min(SLOTS, max(1024, (most or 0) // BLOCK_WORDS))
            shards = shards or min(1 << 16, max(64, int(budget * (every or 0)) // SHARD_WORDS))
        self.n_shards, self.blocks = shards, blocks
        block = (F.col("slot") % blocks).alias("block")
        self.sized = sized.select(id_col, "source", "size", block)
        per_block = store(per_slot.select("source", block, "words").groupBy("source", "block").agg(F.sum("words").alias("words")), "blocks")
        names = ranked(per_block.groupBy("source").agg(F.sum("words").alias("source_size")), F.col("source").asc_nulls_last())
        weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
        names = store(names.withColumn("weight", weight).withColumn("cap", (F.col("source_size") * max_epochs).cast("double")), "sources")
        total = names.agg(F.sum("source_size")).first()[0] or 0
        self.sources = water_filled(names, budget, total)
        same = per_block["source"].eqNullSafe(self.sources["source"])
        quotas = per_block.join(self.sources, same).select("rank", "target", "block", "words")
        placed = store(quotas.groupBy("rank").applyInPandas(_quota(seed, max_epochs), "rank long, place long, block int, epoch int"), "placed")
        slots = placed.count()
        nodes, width = placed.groupBy("rank").agg(F.count(F.lit(1)).alias("quota")).select(F.lit(0).cast("long").alias("shard"), "rank", "quota"), 1
        while width < shards:
            width *= FAN_OUT
        while width > 1:
            nodes = nodes.groupBy("shard").applyInPandas(_split(seed, width, shards, slots), "shard long, rank long, quota long")
            width //= FAN_OUT
        ends = F.sum("quota").over(Window.partitionBy("rank").orderBy("shard"))
        runs = nodes.withColumn("end", ends).select("rank", "shard", F.explode(F.sequence(F.col("end") - F.col("quota"), F.col("end") - 1)).alias("place"))
        named = self.sources.select("rank", "source")
        self.draws = placed.join(runs, ["rank", "place"]).join(named, "rank").select("source", "block", "epoch", "shard")
        self.seed = seed

    def taken(self) -> DataFrame:
        """Every document with its size, its source's size and target, and the words the mix takes of it."""
        times = self.draws.groupBy("source", "block").agg(F.count(F.lit(1)).alias("times"))
        per_block = self.sized.groupBy("source", "block").agg(F.count(F.lit(1)).alias("docs")).alias("b")
        facts = per_block.join(self.sources.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
        facts = facts.join(times.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")) & (F.col("b.block") == F.col("t.block")), "left")
        facts = facts.select(F.col("b.source").alias("of"), F.col("b.block").alias("at"), "source_size", "target", F.coalesce("times", F.lit(0)).alias("times"))
        docs = self.sized.join(facts, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("at")))
        return docs.select(self.id_col, "size", "source_size", "target", (F.col("size") * F.col("times")).cast("long").alias("taken"))

    def rows(self) -> DataFrame:
        """The mixed documents, one row for each draw, with ``shard``, ``epoch`` and ``order`` in the shard (see ``names``)."""
        shard, epoch, order = self.names
        source, block = free_name("w_source", self.docs), free_name("w_block", self.docs)
        draws = self.draws.select(F.col("source").alias(source), F.col("block").alias(block), F.col("epoch").alias(epoch), F.col("shard").alias(shard))
        hit = F.col(self.source_col).eqNullSafe(F.col(source)) & (self.slot % self.blocks == F.col(block))
        place = F.xxhash64(F.lit(self.seed), F.col(shard), F.col(epoch), F.col(self.id_col), F.when(F.col(self.id_col).isNull(), F.col(self.text_col)))
        return self.docs.join(draws, hit).drop(source, block).withColumn(order, place)

    def shards(self) -> DataFrame:
        """``rows``, partitioned by shard and shuffled inside it: in the order of a keyed hash."""
        shard, _, order = self.names
        return self.rows().repartition(self.n_shards, shard).sortWithinPartitions(shard, order, self.id_col)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).taken()
