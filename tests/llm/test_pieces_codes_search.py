"""SentencePiece ids, vector codes and ranked search against the library, plain loops and SQL."""

import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from tallyspark.llm import ranked_search, sentence_pieces, vector_codes

SPACE = "▁"


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=sentence_pieces.default_model())


def drawn_text(rng, vocab):
    kind = rng.random()
    if kind < 0.3:
        return "".join(rng.choice(vocab).replace(SPACE, " " if rng.random() < 0.9 else SPACE) for _ in range(rng.randint(0, 30)))
    if kind < 0.5:
        return "".join(rng.choice(" \n\tab▁-=*é漢字仮が😀\x00̀") for _ in range(rng.randint(0, 60)))
    if kind < 0.7:
        return "".join(chr(rng.choice([rng.randint(0, 0x7F), rng.randint(0x80, 0x2FFF), rng.randint(0x3000, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(rng.randint(0, 20)))
    if kind < 0.9:
        return "".join(rng.choice("aeinrst") * rng.randint(1, 4) for _ in range(rng.randint(0, 80)))
    return rng.choice(" ab-=*\n") * rng.randint(0, 700)


def test_ids_as_the_library(library):
    rng, model = random.Random(11), sentence_pieces.Pieces.of(sentence_pieces.default_model())
    vocab = [library.id_to_piece(k) for k in range(259, library.vocab_size())]
    for _ in range(20):
        texts = [drawn_text(rng, vocab) for _ in range(60)]
        for text, ids, want in zip(texts, model.encode(texts), library.encode(texts, add_eos=True, num_threads=1), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == want, text
            assert model.decode(ids).decode() == library.decode(want), text


def test_any_ids_decode_as_the_library(library):
    rng, model = random.Random(12), sentence_pieces.Pieces.of(sentence_pieces.default_model())
    for _ in range(2000):
        ids = [rng.choice([rng.randint(0, 31999), rng.randint(0, 260), rng.randint(0, 2), 259 + rng.randint(0, 40), 29871]) for _ in range(rng.randint(0, 8))]
        assert model.decode(np.array(ids, "<u4").tobytes()).decode() == library.decode(ids), ids


def test_small_caches_and_blocks(library, monkeypatch):
    for name, value in (("CACHE_WORDS", 5), ("LONG_WORD", 4), ("BLOCK_CHARS", 50), ("BLOCK_WORDS", 7), ("BLOCK_IDS", 3), ("ROUND_SYMBOLS", 9), ("LONG_SEGMENT", 6)):
        monkeypatch.setattr(sentence_pieces, name, value)
    model = sentence_pieces.Pieces(sentence_pieces.default_model())
    texts = ["the quick brown fox jumps over the lazy dog " * 9, "übergänge 漢字仮名😀😀 " * 11, "      \n\n   x", "a" * 300, "", None]
    for text, ids in zip(texts, model.encode(texts), strict=True):
        want = library.encode(text or "", add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert model.decode(ids).decode() == library.decode(want)


def test_long_runs(library):
    model = sentence_pieces.Pieces.of(sentence_pieces.default_model())
    for text in (" " * 20_000 + "x", "ab" * 9000, "漢字仮名交じり文" * 4000, "a" * 20_000):
        assert np.frombuffer(model.encode([text])[0], "<u4").tolist() == library.encode(text, add_eos=True)


def test_pieces_over_awkward_rows(spark, library):
    rows = [(1, "a b", 7, "x"), (1, "a b", 7, "x"), (2, None, 8, None), (None, "", None, "y"), (3, "word " * 3000, 9, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int, decoded string")
    coded = sentence_pieces.encode(docs, sentence_pieces.default_model())
    assert coded.columns == ["doc_id", "text", "ids", "decoded", "ids_"]
    out = sentence_pieces.decode(coded, sentence_pieces.default_model(), ids_col="ids_").collect()
    assert len(out) == 5 and all(r["decoded_"] == (r["text"] or "") for r in out)
    assert all(np.frombuffer(r["ids_"], "<u4").tolist() == library.encode(r["text"] or "", add_eos=True) for r in out)
    for r in sentence_pieces.digest(docs, sentence_pieces.default_model()).collect():
        text = next(t or "" for d, t, *_ in rows if d == r["doc_id"])
        ids = library.encode(text, add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert sentence_pieces.digest(docs.limit(0), sentence_pieces.default_model()).count() == 0


def plain_codes(rows):
    """(id, code, error, label_error) by loops over all entries, and the final codebooks."""
    kept = [(i, label, [math.floor(1024 * float(x)) for x in v]) for i, label, v in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, np.array(r[2], np.int32).tobytes()))
    width = len(kept[0][2]) // 4
    parts = [[v[p * width : (p + 1) * width] for _, _, v in kept] for p in range(4)]
    books = [[list(v) for v in some[:256]] for some in parts]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, book: min((distance(v, e), k) for k, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            groups = {}
            for v in parts[p]:
                groups.setdefault(near(v, books[p])[1], []).append(v)
            for k, some in groups.items():
                books[p][k] = [sum(c) // len(some) for c in zip(*some, strict=True)]
    out, by_label = [], Counter()
    for j, (i, label, _) in enumerate(kept):
        found = [near(parts[p][j], books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
        by_label[label] += out[-1][2]
    return sorted((i, c, e, by_label[label]) for i, c, e, label in out), books


@pytest.mark.parametrize("n", [3, 400])
def test_codes_as_plain_loops(spark, n, monkeypatch):
    rng = random.Random(n)
    rows = [(k, rng.choice([1, 1, 2, None]), [rng.choice([-1.5, 0.25, 0.0, rng.gauss(0, 1), rng.gauss(0, 1)]) for _ in range(8)]) for k in range(n)]
    rows += [(n, 1, None), (n + 1, 1, [None] + [0.5] * 7), (n + 2, 2, [float("nan")] + [0.5] * 7), (n + 3, 2, [float("inf")] + [0.5] * 7), rows[0]]
    vectors = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3)
    want, books = plain_codes(rows)
    for few in (10, 0):  # sums that are broadcast, and salted ones
        monkeypatch.setattr(vector_codes, "FEW_LABELS", few)
        got = vector_codes.compress(vectors).collect()
        assert sorted((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == want
        assert {r["codebooks_sha256"] for r in got} == {hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()}


def test_codes_of_awkward_tables(spark):
    kind = "vec_id long, label int, embedding array<float>, code string, error string"
    rows = [(None, None, [0.5] * 8, "x", "y"), (1, 2, [], "x", "y"), (2, 2, [0.5] * 7, "x", "y"), (3, None, [-0.5] * 8, None, None)]
    got = {r["vec_id"]: (r["code"], r["error"], r["label_error"]) for r in vector_codes.compress(spark.createDataFrame(rows, kind)).collect()}
    assert got == {3: ("00000000", 0, 0), None: ("01010101", 0, 0)}
    assert vector_codes.compress(spark.createDataFrame([], kind)).count() == 0
    assert vector_codes.compress(spark.createDataFrame(rows[1:3], kind)).count() == 0
    with pytest.raises(Exception, match="65536"):
        vector_codes.compress(spark.createDataFrame([(1, 1, [1e9] * 8, "", "")], kind)).count()


def test_bounds_keep_the_nearest():
    rng = np.random.default_rng(3)
    for spread in (2, 40, 3000, 1 << 25):
        entries, queries = rng.integers(-spread, spread, (200, 5)), rng.integers(-spread, spread, (700, 5))
        entries[50:60] = entries[0]
        found, far = vector_codes.Codebook(entries).nearest(queries)
        every = ((queries[:, None, :] - entries[None]) ** 2).sum(2)
        assert (found == every.argmin(1)).all() and (far == every.min(1)).all()


def plain_ranks(docs, items, k=10):
    cut = lambda text: [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
    tallies = [(i, Counter(cut(t))) for i, t in docs]
    tallies = [(i, c, sum(c.values())) for i, c in tallies if c]
    n, every = len(tallies), sum(x for _, _, x in tallies)
    df = Counter(t for _, c, _ in tallies for t in c)
    asked, out = {}, []
    for i, text in items:
        asked.setdefault(i, set()).update(cut(text))
    for item, some in asked.items():
        scores = []
        for i, c, length in tallies:
            m = 10 + 90 * length * n // every
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in some if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("sizes", [{}, {"SHARD_DOCS": 7, "CELLS": 40, "STEP_CELLS": 30, "BLOCK_TERMS": 12, "SLICE_BYTES": 16}])
def test_ranks_as_plain_loops(spark, sizes, monkeypatch):
    for name, value in sizes.items():
        monkeypatch.setattr(ranked_search, name, value)
    rng = random.Random(5)
    words = ["the", "The", "of", "über", "Übel", "x1", "漢字", *(f"w{k}" for k in range(30))]
    weights = [30, 10, 20, 3, 2, 2, 1, *(30 / (k + 1) for k in range(30))]
    text = lambda n: rng.choice([" ", "-", "\n", "_"]).join(rng.choices(words, weights, k=n))
    docs = [(k, text(rng.randint(0, 60))) for k in range(150)] + [(150, None), (151, ""), (152, ".,;"), (3, "w1 w2 w3"), (None, "w1 w2 w3"), (160, "w1 w2 w3"), (160, "w1 w2 w3"), (161, "w4 w5 " * 2000)]
    items = [(k, text(rng.randint(1, 12))) for k in range(12)] + [(12, None), (13, "none of these: qqq"), (14, "qqq"), (15, "w1, w2, w3!"), (15, "w9"), (None, "w1 w2"), (16, text(80))]
    found = ranked_search.search(spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", ranked_search.F.lit("x")).repartition(3), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", ranked_search.F.lit(1)))
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, found.collect()), key=key) == sorted(plain_ranks(docs, items), key=key)


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id int, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0)), (docs, items.selectExpr("item_id", "CAST(NULL AS STRING) AS text"))):
        found = ranked_search.search(d, i)
        assert found.dtypes == [("item_id", "int"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")] and found.count() == 0


def test_few_documents_are_scored():
    """The documents that the threshold rules out are passed over."""
    rng = np.random.default_rng(8)
    n = 1000
    common, rare = np.arange(n), np.sort(rng.choice(n, 12, replace=False))
    term, doc = np.r_[np.zeros(n, np.int32), np.ones(12, np.int32)], np.r_[common, rare].astype(np.int32)
    impact = np.r_[rng.integers(1, 10, n), rng.integers(1000, 2000, 12)]
    heaps = ranked_search.Heaps(1, 10)
    first = ranked_search.wand(ranked_search._group([np.array([0, 1])]), heaps, np.arange(n), term, doc, impact, 2)
    again = ranked_search.wand(ranked_search._group([np.array([0, 1])]), heaps, np.arange(n) + n, term, doc, impact, 2)
    assert again <= 12 < first < n
    assert set((heaps.doc[0] % n).tolist()) <= set(rare.tolist())


@pytest.mark.parametrize(("module", "name", "query"), [(ranked_search, "OP13_SQL", "op13"), (vector_codes, "OP12_SQL", "op12")])
def test_queries_with_their_sql(spark, module, name, query):
    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as con:
        for t in ("documents", "benchmark", "embeddings"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        want = con.execute(getattr(module, name))
        columns, rows = [d[0] for d in want.description], want.fetchall()
    got = getattr(module, query)(spark, folder)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(rows)
