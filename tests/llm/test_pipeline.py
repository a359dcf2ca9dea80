"""The pipeline's stages on the smallest tables, each against the rows it was given, and on rows of every awkward kind."""

import collections
import hashlib
import os
import random

import pytest

import corpus_pipeline
from tallyspark.llm import mixing, near_dups, quality

DATA = "/root/testdata/sf0.001"
#: Columns of documents, and others with the names that the operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, number string, digest string, shard int, Epoch int, order int, failed int, n_words int, keys string, ids string, w_block int, __text int"
CLASHING = (1, "a", "b", 2, 3, 4, 5, 6, "c", "d", 7, 8)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out.append(stage(spark, out[-1], DATA).persist())
        assert out[-1].columns == docs.columns
    ids = [sorted(r.doc_id for r in x.select("doc_id").collect()) for x in out]
    mask = quality.CURRENT.mask
    good = {r.doc_id for r in quality.ledger(docs).collect() if not r.failed & mask}
    assert set(ids[1]) == good and len(ids[1]) < len(ids[0])
    classes = {r.doc_id: r.class_id for r in near_dups.near_duplicates(out[1]).collect()}
    assert ids[2] == sorted(set(classes.values()))
    assert ids[3] == ids[2] and set(ids[4]) <= set(ids[3])
    assert max(ids[4].count(i) for i in set(ids[4])) <= 2
    done = corpus_pipeline.run(spark, DATA)
    assert sorted(r.doc_id for r in done.collect()) == ids[4]
    assert done.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


@pytest.fixture(scope="module")
def awkward():
    """(doc_id, text, source): nulls, empty and long texts, ties, repeated rows, rows that share an id."""
    rng = random.Random(21)
    text = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    plain = [(k, text(rng.randrange(60, 90)), f"s{k % 3}") for k in range(24)]
    same, long = text(70), text(30_000)
    return [
        *plain, *plain[:2], (30, same, "s0"), (31, same, "s1"), (31, text(65), "s1"), (None, same, "s0"), (None, text(80), None), (None, None, None),
        (40, None, "s2"), (41, "", "s2"), (42, " \n", None), (43, long + " card 4111 1111 1111 1111", "s0"), (44, "tie " * 80, "s1"), (45, text(60) + " mail ann.lee@mail2.example.com", None),
    ]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *CLASHING) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("number", range(5))
def test_stage_on_awkward_rows(spark, awkward, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = frame(spark, awkward)
    out = stage(spark, docs, "")
    got = out.collect()
    if number < 4:
        assert out.columns == docs.columns and all(tuple(r[5:]) == CLASHING for r in got)
    key = lambda r: (r.doc_id, r.text)
    rows, found = collections.Counter((i, t) for i, t, _ in awkward), None if number == 4 else collections.Counter(map(key, got))
    if number == 0:
        assert found == collections.Counter({k: n for k, n in rows.items() if k[1] and len(k[1].split()) >= 50 and not k[1].startswith("tie")})
    if number == 1:
        least = lambda k: hashlib.sha256(awkward[k][1].encode()).digest()
        other = [] if least(27) < least(28) else [31]  # of the two texts of 31, the one with the least digest counts; the first is that of 30
        assert collections.Counter(i for i, _ in found.elements()) == collections.Counter([*range(24), 30, *other, None, 40, 42, 43, 44, 45])
        assert set(found) <= set(rows) and (None, awkward[30][1]) in found
    if number == 2:
        changed = [r for r in got if (r.doc_id, r.text) not in rows]
        assert sorted(r.doc_id for r in changed) == [43, 45] and len(got) == len(awkward) and all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)
    if number == 3:
        assert set(found) <= set(rows) and all(n <= 2 * rows[k] for k, n in found.items()) and got
    if number == 4:
        want = collections.Counter((i, hashlib.sha256((t or "").encode()).hexdigest()) for i, t, _ in awkward)
        assert collections.Counter((r.doc_id, r.decoded_sha256) for r in got) == want and all((r.n_tokens == 0) == (r.decoded_sha256 == hashlib.sha256(b"").hexdigest()) for r in got)
    empty = stage(spark, docs.limit(0), "")
    assert empty.count() == 0 and empty.columns == out.columns


def test_shards_hold_their_draws_in_keyed_order(spark, awkward):
    mix = mixing.Mix(frame(spark, awkward), shards=4, blocks=8)
    shard, epoch, order = mix.names
    assert (shard, epoch, order) == ("shard_", "epoch_", "order_")
    parts = mix.shards().rdd.glom().collect()
    seen = [r[shard] for p in parts for r in p]
    assert len({s for s in seen}) == len([1 for k, s in enumerate(seen) if k == 0 or s != seen[k - 1]])  # each shard in one run
    for part in parts:
        places = [(r[shard], r[order]) for r in part]
        assert places == sorted(places)
    drawn = collections.Counter(r.shard for r in mix.draws.collect())
    slots = sum(drawn.values())
    assert [drawn[k] for k in range(4)] == [slots * (k + 1) // 4 - slots * k // 4 for k in range(4)]
