"""The corpus operators against brute force on small tables with nulls, empty and long texts, repeated rows,
no rows at all, and columns whose names they use themselves."""

import collections
import hashlib
import random
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from test_near_dup_recall import edit_similarity

from tallyspark.llm import bpe, embeddings, licenses, mixing, near_dups, packing, pii, quality, substrings, suffixes
from tallyspark.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id int, digest string, keys string, n string"


def table(spark, texts, sources=None, ids=None):
    rows = [((ids or range(len(texts)))[i], t, "en", (sources or ["s"] * len(texts))[i], len(t or ""), 1, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n, vocabulary=2000):
    return [f"w{rng.randrange(vocabulary)}é" if rng.random() < 0.1 else f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(11)
    base = words(rng, 300)
    passage = words(rng, 90)
    out = [None, "", " \n\t ", "one", "two words", " ".join(base), " ".join(base), " ".join(base[:280])]
    for _ in range(6):
        near = list(base)
        for _ in range(6):
            near[rng.randrange(len(near))] = "changed"
        out.append("  ".join(near) if rng.random() < 0.3 else " ".join(near))
    out += [" ".join(words(rng, 60) + passage + words(rng, 60)) for _ in range(25)]
    out += [" ".join(words(rng, rng.randrange(1, 120), 40)) for _ in range(20)]
    out += ["ab" * 30_000, "x " * 3_000, "\n".join(["same line here"] * 30), "!" * 700 + " \r\x0b\x0c end", "mail a.b@c.org " * 20]
    return out


def norm(t):
    return (t or "").encode().split()


# 1


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((60, 8))
    vecs = [v.tolist() for v in base] + [(base[i % 5] + rng.standard_normal(8) * s).tolist() for i in range(60) for s in (0.02, 0.25)]
    vecs += [base[0].tolist()] * 9 + [(base[1] * 1e6).tolist(), [0.0] * 8, None, [], [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0, None] + [0.0] * 6, base[2][:4].tolist()]
    ids = list(range(1000, 1000 + len(vecs)))
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in zip(ids, vecs)], "vec_id long, embedding array<double>, label int, id int")
    good = [k for k, v in enumerate(vecs) if v and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    unit = np.array([vecs[k] for k in good])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    linked = unit @ unit.T >= 0.95
    np.fill_diagonal(linked, False)
    comp, links = {i: i for i in ids}, collections.Counter()
    for a, k in enumerate(good):
        links[ids[k]] = int(linked[a].sum())
    while True:
        before = dict(comp)
        for a, b in zip(*np.nonzero(linked)):
            comp[ids[good[a]]] = min(comp[ids[good[a]]], comp[ids[good[b]]])
        if before == comp:
            break
    old = embeddings.BLOCK
    embeddings.BLOCK = 32
    try:
        got = embeddings.near_vectors(df.unionByName(df.limit(3))).collect()
    finally:
        embeddings.BLOCK = old
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (links[i], comp[i], comp[i] == i) for i in ids} and len(got) == len(ids)
    assert embeddings.near_vectors(df.limit(0)).count() == 0
    some = rng.standard_normal((5000, 4)) + np.array([9.0, 0, 0, 0])  # all near each other: more pairs between two blocks than leave a tile
    near = embeddings.near_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(some)], "vec_id long, embedding array<double>")).collect()
    some /= np.linalg.norm(some, axis=1)[:, None]
    links = (some @ some.T >= 0.95).sum(1) - 1
    assert sum(abs(r.n_links - links[r.vec_id]) > 0 for r in near) == 0 and len(near) == 5000 and len({r.component_id for r in near}) == 1
    null = embeddings.near_vectors(spark.createDataFrame([(None, [1.0, 0.0]), (None, [0.0, 1.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in null} == {(None, 0, None, True), (4, 0, 4, True)} and len(null) == 2


def test_regions_bound_their_vectors():
    rng = np.random.default_rng(5)
    units = rng.standard_normal((40, 6)) + np.array([4.0, 0, 0, 0, 0, 0])
    units /= np.linalg.norm(units, axis=1)[:, None]
    blocks = [units[k : k + 10] for k in range(0, 40, 10)]
    centres = [embeddings._centre(b) for b in blocks]
    reach = [float(np.arccos(np.clip(b @ c, -1, 1)).max()) for b, c in zip(blocks, centres)]
    (region,) = embeddings._region(pd.DataFrame({"dim": 6, "region": 0, "centre": [c.tolist() for c in centres], "reach": reach})).to_dict("records")
    assert (np.arccos(np.clip(units @ np.array(region["centre"]), -1, 1)) <= region["reach"]).all()


def test_quantisation_bound():
    rng = np.random.default_rng(1)
    v = rng.standard_normal((200, 64)) * np.exp(rng.standard_normal((200, 64)))
    unit, code, scale, error = embeddings.quantise(v)
    miss = np.abs(unit @ unit.T - scale[:, None] * scale * (code.astype(np.int64) @ code.T.astype(np.int64)))
    assert (miss <= error[:, None] + error + 3 * error[:, None] * error).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 540)] + [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(70)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_ranks_and_stored_tables(spark):
    from tallyspark.llm.common import forget, ranked, stored_in

    df = spark.range(1000).selectExpr("id * 7919 % 1000 AS v").repartition(7)
    assert sorted((r.rank, r.v) for r in ranked(df, "v").collect()) == [(k, k) for k in range(1000)]
    assert ranked(df.limit(0), "v").count() == 0
    folder = stored_in(spark)
    assert spark.read.schema("v long").parquet(f"{folder}/ranked-*").filter("v IS NOT NULL").count() == 1000
    forget(spark)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(f"{folder}/ranked-*")


# 2


def test_mixing(spark, texts):
    rng = random.Random(3)
    many = texts + [" ".join(words(rng, rng.randrange(5, 60))) for _ in range(300)]
    sources = [rng.choice(["b", "a", "B", "é", None]) if i % 3 else "a" for i in range(len(many))]
    df = table(spark, many, sources)
    mix = mixing.Mix(df, shards=16)
    got = {r.doc_id: r for r in mix.taken().collect()}
    size = {i: len(norm(t)) for i, t in enumerate(many)}
    per = collections.Counter()
    for i, s in enumerate(sources):
        per[s] += size[i]
    names = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(per.values()), set(names)
    while True:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * per[s] <= share * weight[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * per[s]
            left -= 2 * per[s]
        free -= full
    target |= {s: share * weight[s] for s in free}
    taken = collections.Counter()
    for i, s in enumerate(sources):
        assert (got[i].size, got[i].source_size) == (size[i], per[s]) and got[i].target == pytest.approx(target[s])
        assert got[i].taken in (0, size[i], 2 * size[i])
        taken[s] += got[i].taken
    assert all(abs(taken[s] - target[s]) <= 0.02 * per[s] + 60 for s in names)
    rows = mix.rows().select("doc_id", "shard", "epoch").collect()
    assert len(set(rows)) == len(rows)
    assert collections.Counter(r.doc_id for r in rows) == {i: got[i].taken // size[i] for i in got if size[i] and got[i].taken} | {r.doc_id: n for r, n in collections.Counter(rows).items() if not size[r.doc_id]} | {i: n for i, n in collections.Counter(r.doc_id for r in rows).items() if not size[i]}
    again = {r.doc_id: r.taken for r in mixing.Mix(df.repartition(7), shards=16).taken().collect()}
    assert again == {i: r.taken for i, r in got.items()}
    assert mixing.Mix(df.limit(0)).taken().count() == 0 and mixing.Mix(df.limit(0)).rows().count() == 0


# 3


def test_pii(spark):
    cases = ["mail ann.lee@mail2.example.com, ann.lee@mail2.example.com!", "card 4111 1111 1111 1111 not 4111 1111 1111 1112", "ip 10.20.30.40 not 300.1.1.1", "born 1987-02-28, 28.02.1987 not 1987-02-30", "call +1 (555) 555-1234", "ssn 123-45-6789", "iban DE89370400440532013000", 'token = "0123456789abcdef0123456789abcdef"', "plain 12 words, no. 7", None, "", "9" * 50_000, "a@" * 20_000]
    df = table(spark, cases)
    got = {r.doc_id: r for r in pii.mask(df, "k", counts_col="found").collect()}
    new = {i: got[i].text for i in got}
    for i, gone in ((0, "ann.lee@mail2.example.com"), (1, "4111 1111 1111 1111"), (2, "10.20.30.40"), (3, "1987-02-28"), (4, "(555) 555-1234"), (5, "123-45-6789"), (6, "DE89370400440532013000"), (7, "0123456789abcdef")):
        assert gone not in new[i] and len(got[i].found) == len(pii.KINDS) and sum(got[i].found) >= 1
    assert "4111 1111 1111 1112" in new[1] and "300.1.1.1" in new[2] and "1987-02-30" in new[3]
    assert [new[i] for i in (8, 9, 10, 11)] == [cases[i] for i in (8, 9, 10, 11)] and sum(got[8].found) == 0
    a, b = new[0][5:].rstrip("!").split(", ")
    assert a == b and a.endswith(".com") and a != cases[0]
    same = {r.text for r in pii.mask(table(spark, ["x 10.20.30.40"]), "k").collect()}
    assert new[2].split()[1] in next(iter(same))
    digits = "".join(c for c in new[1].split(" not")[0] if c.isdigit())
    assert len(digits) == 16 and int(digits[-1]) == pii._luhn(digits[:-1])
    assert pii.mask(df.limit(0), "k").count() == 0 and pii.mask(df, "k").columns == df.columns


def test_feistel_permutes():
    f = pii.Feistel(b"key")
    assert len({f.within(i, 777, "t") for i in range(777)}) == 777
    assert {f.string(f"{i:03d}", [pii.DIGITS] * 3, "t") for i in range(1000)} == {f"{i:03d}" for i in range(1000)}
    assert len({pii._ssn(f, f"{a:03d}-01-0001") for a in range(1, 400)}) == 399


# 4


def test_quality(spark, texts):
    df = table(spark, texts + ["AND SO ON!! " * 30 + " ".join(f"W{i}" for i in range(60)), " ".join(f"a{i}###" for i in range(80)), " ".join(words(random.Random(1), 80))])
    rows = quality.ledger(df).collect()
    assert len(rows) == df.count()
    for r, text in zip(sorted(rows), [x.text or "" for x in sorted(df.collect())]):
        w = norm(text)
        seen = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        cover = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = [x for x in text.split("\n") if x.encode().split()]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(w), len(cover), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(x.decode()) for x in w) and r.n_symbols == sum(text.count(c) for c in "#*$%&|<>")
        assert bool(r.failed & 1) == (len(w) < 50) and bool(r.failed & 2) == (100 * len(cover) > 50 * len(w))
    kept = quality.keep_good(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if r.failed & quality.CURRENT.mask == 0}
    policy = quality.CURRENT
    for a in quality.ablations(quality.ledger(df)).collect():
        bits = [r.failed & policy.mask for r in rows]
        assert (a.n_failed, a.n_failed_alone, a.n_kept_without) == (sum(b >> a.rule & 1 for b in bits), sum(b == 1 << a.rule for b in bits), sum(b & ~(1 << a.rule) == 0 for b in bits))
    assert quality.ledger(df.limit(0)).count() == 0


# 5


def test_best_fit():
    rng = random.Random(9)
    for _ in range(100):
        width = rng.choice([7, 16, 50])
        lengths = sorted((rng.randint(1, width) for _ in range(rng.randint(1, 80))), reverse=True)
        used = []
        for n, (row, offset) in zip(lengths, packing.best_fit(lengths, width)):
            room = [width - u for u in used if width - u >= n]
            if room:
                assert width - used[row] == min(room) and offset == used[row]
            else:
                assert row == len(used) and offset == 0
                used.append(0)
            used[row] += n


def test_packing(spark, texts, encoding):
    path, pattern = bpe.default_vocabulary()
    df = table(spark, texts)
    blocks = packing.packed(df, path, pattern, width=64)
    got = packing.segments(blocks).collect()
    want = set()
    for i, t in enumerate(texts):
        ids = encoding.encode_ordinary(t or "")
        want |= {(i, k // 64, hashlib.sha256(struct.pack(f"<{len(ids[k : k + 64])}I", *ids[k : k + 64])).hexdigest()) for k in range(0, len(ids), 64)}
    assert {(r.doc_id, r.part, r.ids_sha256) for r in got} == want and len(got) == len(want) and all(r.positions_reset for r in got)
    rows = collections.defaultdict(list)
    for r in got:
        rows[r.shard, r.row].append((r.start, r.length))
    for spans in rows.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 64
    assert packing.packed(df.limit(0), path, pattern).count() == 0
    null = packing.segments(packing.packed(spark.createDataFrame([(None, "a b c"), (None, "d e"), (1, None)], "doc_id long, text string"), path, pattern)).collect()
    assert [r.doc_id for r in null] == [None, None]


# 6


def test_licenses(spark):
    rng = random.Random(8)
    docs, want = [None, "", "one two", "licensed under the moon"], set()
    for k, (name, notice) in enumerate(licenses.TEMPLATES):
        at = rng.randrange(400)
        filler = words(rng, at)
        docs.append(" ".join(filler) + "\n" + notice.upper() + "\n" + " ".join(words(rng, 50)))
        want.add((len(docs) - 1, name))
    docs.append(" ".join(words(rng, 20_000)) + " Released under the MIT License. " + " ".join(words(rng, 2_000)))
    want.add((len(docs) - 1, "MIT"))
    got = licenses.scan(table(spark, docs)).collect()
    assert {(r.doc_id, r.license) for r in got} == want
    assert next(r for r in got if r.doc_id == len(docs) - 1).first_word == 20_000
    assert all(licenses.collision_probability(licenses.least_similarity(n)) > 0.9999 for n in licenses.Templates(licenses.TEMPLATES).words)
    assert licenses.scan(table(spark, docs).limit(0)).count() == 0


# 7


def test_super_kmers(spark, texts, monkeypatch):
    ids = list(range(len(texts)))
    random.Random(6).shuffle(ids)
    df = table(spark, texts, ids=ids).repartition(5)
    seen, want = {}, {}
    for i, t in sorted(zip(ids, texts)):
        w = norm(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if seen.setdefault(tuple(w[k : k + 20]), (i, k)) != (i, k):
                gone[k : k + 20] = [True] * 20
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    for hot in (False, True):
        if hot:  # every minimiser counts as hot: windows travel one by one
            monkeypatch.setattr(substrings, "LEAST_HOT", 0)
            monkeypatch.setattr(substrings, "hot_share", lambda windows, buckets: 0)
        got = substrings.dedup_windows(df).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == want and len(got) == len(want)
    twice = substrings.dedup_windows(df.unionByName(df)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in twice) == {(i, *w): 2 for i, w in want.items()}
    assert substrings.dedup_windows(df.limit(0)).count() == 0
    null = substrings.dedup_windows(spark.createDataFrame([(None, " ".join(words(random.Random(2), 30))), (3, " ".join(words(random.Random(2), 30)))], "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_removed) for r in null} == {None: (30, 0), 3: (30, 30)}


def test_thinly_spread_minimisers_are_counted(monkeypatch):
    """A minimiser with a window or two in each step counts over all steps, whatever a task holds at once."""
    monkeypatch.setattr(substrings, "STEP_BYTES", 300)
    rng = random.Random(12)
    phrase = words(rng, 20)
    texts = [" ".join(words(rng, 9, 10**6) + phrase + words(rng, 9, 10**6)) for _ in range(200)]
    batches = [pa.RecordBatch.from_arrays([pa.array([t])], ["text"]) for t in texts]

    def counts():
        out = collections.Counter()
        for batch in substrings._count(iter(batches)):
            for k, n in zip(batch["kind"].to_pylist(), batch["n"].to_pylist()):
                out[k] += n
        return out

    whole = counts()
    monkeypatch.setattr(substrings, "COUNTS_HELD", 40)
    assert counts() == whole and sum(whole.values()) == 200 * (38 - 19)
    ((_, most),) = whole.most_common(1)
    assert most >= 200


# 8


def test_suffix_sorting():
    rng = random.Random(1)
    old = suffixes.WINDOW
    try:
        for _ in range(150):
            suffixes.WINDOW = w = rng.choice([4, 6, 8, 12])
            strings = list(dict.fromkeys(bytes(rng.choice(b"aab") for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 6))))
            times = collections.Counter(s[i : i + w] for s in strings for i in range(len(s) - w + 1))
            assert [x.tolist() for x in suffixes.repeats(strings)] == [[i for i in range(len(s) - w + 1) if times[s[i : i + w]] > 1] for s in strings]
    finally:
        suffixes.WINDOW = old


def test_long_texts_in_slices(monkeypatch):
    """Every window is in one segment, with the minimiser that it has in the whole text."""
    rng = random.Random(8)
    text = "".join(rng.choice("abc é") for _ in range(6_000))
    batch = pa.RecordBatch.from_arrays([pa.array([5]), pa.array([6]), pa.array([text])], ["id", "digest", "text"])

    def windows():
        out = {}
        for found in suffixes._list_segments(iter([batch])):
            for r in found.to_pylist():
                assert r["id"] == 5 and r["n"] == 1
                for w in range(r["start"], r["start"] + r["size"]):
                    assert out.setdefault(w, (r["print"], r["mark"])) == (r["print"], r["mark"]) and 0 <= r["mark"] - w <= 368
        return out

    whole = windows()
    monkeypatch.setattr(suffixes, "STEP_BYTES", 700)
    assert windows() == whole and len(whole) == len(text.encode()) - 399


@pytest.mark.parametrize("hot", [10**6, 3, 1])
def test_repeated_bytes(spark, texts, monkeypatch, hot):
    """With a low bound for hot fingerprints, all are cut in parts, and again in single windows."""
    monkeypatch.setattr(suffixes, "HOT_KINDS", hot)
    many = texts + ["abc" * 400, "q" * 399, "q" * 400, "q" * 401, "r" * 400]
    df = table(spark, many).repartition(4)
    times = collections.Counter()
    for t in many:
        b = (t or "").encode()
        times.update(b[k : k + 400] for k in range(len(b) - 399))
    got = suffixes.dedup_bytes(df).collect()
    assert len(got) == len(many)
    for r in got:
        b = (many[r.doc_id] or "").encode()
        steps = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 399):
            if times[b[k : k + 400]] > 1:
                steps[k] += 1
                steps[k + 400] -= 1
        gone = np.cumsum(steps[:-1]) > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), gone.sum(), spans, hashlib.sha256(kept).hexdigest())
    assert suffixes.dedup_bytes(df.limit(0)).count() == 0


# 9


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment():
    rng = random.Random(3)
    for _ in range(1500):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        b = list(a) if rng.random() < 0.6 else [rng.choice("abcd") for _ in range(rng.randint(0, 14))]
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = [rng.choice("abcd")] * rng.randint(0, 1)
        d = edit_distance(a, b)
        assert all(near_dups.distance_within(a, b, m) == (d if d <= m else None) for m in (0, 1, 2, 3, 5, 20))


def test_alignment_of_long_texts(monkeypatch):
    """With narrow masks, and of texts whose words are nearly all distinct."""
    rng = random.Random(9)
    a = [f"w{rng.randrange(50)}" for _ in range(300)]
    b = [w if rng.random() < 0.9 else "x" for w in a[5:]]
    d = edit_distance(a, b)
    for mask in (7, 64, 1024):
        monkeypatch.setattr(near_dups, "MASK", mask)
        assert near_dups.distance_within(a, b, d) == d and near_dups.distance_within(a, b, d - 1) is None and near_dups.distance_within(b, a, 200) == d
    long = [f"w{k}" for k in range(60_000)]
    assert near_dups.distance_within(long, [*long[:30_000], "x", *long[30_010:]], 64) == 10


def test_near_duplicates(spark, texts):
    ids = [3 * i for i in range(len(texts))]
    df = table(spark, texts, ids=ids)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, a in enumerate(texts):
        for m, b in enumerate(texts[:k]):
            x, y = norm(a), norm(b)
            longer = max(len(x), len(y))
            same = (a or "") == (b or "") or longer >= 5 and min(len(x), len(y)) >= 0.8 * longer and edit_similarity(x, y) >= 0.8 - 1e-9
            if same:
                p, q = find(ids[k]), find(ids[m])
                parent[max(p, q)] = min(p, q)
    got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(df).collect()}
    assert got == {i: find(i) for i in ids}
    kept = near_dups.keep_first(df.unionByName(df))
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in ids})
    assert near_dups.near_duplicates(df.limit(0)).count() == 0


def test_large_buckets(spark):
    """Many texts around one passage share buckets of all sketches; two of them are near copies."""
    rng = random.Random(5)
    passage = words(rng, 40)
    docs = [" ".join(words(rng, 20, 10**6) + passage + words(rng, 20, 10**6)) for _ in range(120)]
    docs.append(docs[60].replace(passage[3], "other", 1))
    for exhaustive in (False, True):
        got = {r.doc_id: r.class_id for r in near_dups.near_duplicates(table(spark, docs), exhaustive=exhaustive).collect()}
        assert got == {i: 60 if i == 120 else i for i in range(121)}


# 10


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    path, pattern = bpe.default_vocabulary()
    return tiktoken.Encoding("test", pat_str=pattern, mergeable_ranks=bpe.Codec.of(path, pattern).ranks, special_tokens={})


def test_bpe(spark, texts, encoding):
    many = texts + ["🙂" * 300, "a　b  c\x1c d", "<|endoftext|>", "l'été 2024½ ﬀ"]
    df = table(spark, many)
    path, pattern = bpe.default_vocabulary()
    for r in bpe.digest(df, path, pattern).collect():
        text = many[r.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    coded = bpe.decode(bpe.encode(df, path, pattern), path, pattern)
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in coded.collect())
    assert bpe.digest(df.limit(0), path, pattern).count() == 0
    clash = bpe.decode(bpe.encode(df.withColumnRenamed("keys", "IDS").withColumnRenamed("digest", "decoded"), path, pattern), path, pattern, ids_col="ids_")
    assert clash.columns[-2:] == ["ids_", "decoded_"] and all(bytes(r.decoded_) == (r.text or "").encode() and (r.IDS, r.decoded) == ("y", "x") for r in clash.collect())


def test_bpe_of_long_texts(encoding):
    """Text without blanks between its signs, and very long texts, in one step each."""
    rng = random.Random(7)
    signs = "".join("".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(rng.randrange(10, 61))) + rng.choice("，。 ") for _ in range(9_000))
    own = [f"{w}{rng.randrange(10**4)} " for w in words(rng, 3_000)]
    long = "".join(rng.choices(own, k=9_500_000)) + "=" * 300_000 + "\n" * 9_000
    codec = bpe.Codec.of(*bpe.default_vocabulary())
    for text in (signs, long):
        (ids,) = codec.encode([text])
        assert np.array_equal(np.frombuffer(ids, "<u4"), np.array(encoding.encode_ordinary(text), np.uint32))
        assert codec.decode([b"", ids, b""]) == [b"", text.encode(), b""]
