"""Rows that are repeated very often, and very many rows without an id."""

import hashlib
import random
import re
import time
from collections import Counter

import pytest

from tallyspark.llm import licenses, mixing, packing, substrings, suffixes

DOCS = "doc_id long, text string"


def cut_bytes(rows):
    """(id, n_bytes, n_removed, n_spans, digest) of each row by looking every window up in all of them."""
    raws = [(i, (t or "").encode()) for i, t in rows]
    width = suffixes.WINDOW
    seen = Counter(raw[k : k + width] for _, raw in raws for k in range(len(raw) - width + 1))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for k in range(len(raw) - width + 1):
            if seen[raw[k : k + width]] > 1:
                gone[k : k + width] = b"\1" * width
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def cut_words(rows):
    """(id, n_words, n_removed, digest) of each row; rows that share an id are one document."""
    cut = [(-1 if i is None else i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    n = substrings.N
    first = {}
    for i, ws in cut:
        for k in range(len(ws) - n + 1):
            win = tuple(ws[k : k + n])
            first[win] = min(first.get(win, (i, k)), (i, k))
    out = []
    for i, ws in cut:
        gone = set()
        for k in range(len(ws) - n + 1):
            if first[tuple(ws[k : k + n])] < (i, k):
                gone.update(range(k, k + n))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out.append((None if i < 0 else i, len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def rows_with_repeats(rng, times):
    word = lambda: f"w{rng.randrange(10**6)}"
    text = " ".join(word() for _ in range(300))
    part = " ".join(text.split()[40:200])
    rows = [(5, text)] * times + [(9, text), (1, f"{word()} {part} {word()}"), (None, text), (None, text), (None, part), (None, f"a {part}"), (7, None), (7, ""), (8, "short")]
    rows += [(k, " ".join(word() for _ in range(100))) for k in range(20, 40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("times", "hot"), [(2, 1000), (40, 1000), (40, 3)])
def test_bytes_of_repeated_rows(spark, times, hot, monkeypatch):
    monkeypatch.setattr(suffixes, "LEAST_HOT", hot)
    rows = rows_with_repeats(random.Random(times), times)
    got = suffixes.dedup_bytes(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert Counter(map(tuple, got)) == cut_bytes(rows)


@pytest.mark.parametrize("times", [2, 40])
def test_words_of_repeated_rows(spark, times, monkeypatch):
    monkeypatch.setattr(substrings, "STEP_BYTES", 20_000)
    rows = rows_with_repeats(random.Random(times), times)
    got = substrings.dedup_windows(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert Counter(map(tuple, got)) == cut_words(rows)


def test_null_ids_of_many_texts(spark):
    rng = random.Random(7)
    rows = [(None, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(15, 60)))) for _ in range(3000)]
    rows += [(None, t + " tail") for _, t in rows[:300]]
    got = substrings.dedup_windows(spark.createDataFrame(rows, DOCS).repartition(5)).collect()
    assert Counter(map(tuple, got)) == cut_words(rows)


@pytest.mark.parametrize("cut", [suffixes.dedup_bytes, substrings.dedup_windows])
def test_time_follows_the_repetitions(spark, cut):
    text = " ".join(f"w{k * k % 9973}" for k in range(2000))
    other = " ".join(text.split()[100:1500])

    def seconds(times):
        df = spark.range(times).selectExpr("5L AS doc_id").withColumn("text", suffixes.F.lit(text)).unionByName(spark.createDataFrame([(1, other)], DOCS))
        began = time.time()
        assert len(cut(df.repartition(8)).select("n_removed").distinct().collect()) == 2
        return time.time() - began

    seconds(50)
    few, many = seconds(200), seconds(3200)
    assert many < 10 * few + 10, (few, many)


def test_licenses_of_repeated_rows(spark):
    rows = [(None, "Released under the MIT License.")] * 3 + [(1, "x Licensed under the Apache License, Version 2.0. y")] * 50 + [(1, None), (None, None), (1, "none")]
    found = licenses.scan(spark.createDataFrame(rows, DOCS).repartition(3)).groupBy("doc_id", "license", "first_word").count().collect()
    assert sorted((r["doc_id"] or 0, r["license"], r["first_word"], r["count"]) for r in found) == [(0, "MIT", 0, 3), (1, "Apache-2.0", 1, 50)]


def test_packing_spreads_rows(spark):
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    text = "some words that are packed " * 40
    tables = {"null ids": [(None, f"{k} {text}") for k in range(4000)], "one row": [(3, text)] * 4000, "ids": [(k, text) for k in range(4000)]}
    packing.SHARD_BYTES, before = 1 << 18, packing.SHARD_BYTES
    try:
        for name, rows in tables.items():
            found = packing.segments(packing.packed(spark.createDataFrame(rows, DOCS).repartition(4), path, pattern)).groupBy("shard").count().collect()
            sizes = [r["count"] for r in found]
            assert sum(sizes) == 4000 and len(sizes) >= 15 and max(sizes) < 3 * 4000 / len(sizes), (name, sizes)
    finally:
        packing.SHARD_BYTES = before


def test_mix_of_rows_without_ids(spark):
    rng = random.Random(3)
    rows = [(None, "ab"[k % 4 == 0], f"{k} " + "word " * rng.randrange(20, 120)) for k in range(12_000)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    taken = {r["source_size"]: (r["target"], r["taken"]) for r in mix.taken().groupBy("source_size").agg(mixing.F.max("target").alias("target"), mixing.F.sum("taken").alias("taken")).collect()}
    most = mix.sized.groupBy("source", "block").agg(mixing.F.sum("size").alias("n")).agg(mixing.F.max("n")).first()[0]
    assert len(taken) == 2 and all(abs(target - got) <= most for target, got in taken.values()), (taken, most)
