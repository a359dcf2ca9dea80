"""Near-duplicates at and above the threshold: recall over scattered changes, and pairs inside large buckets."""

import random

import numpy as np

from tallyspark.llm import near_dups

DOCS = "doc_id long, text string"


def changed(rng, ws, n, within=None):
    out = list(ws)
    for k in rng.sample(within or range(len(ws)), n):
        out[k] = f"c{rng.randrange(10**9)}"
    return out


def fresh(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def classes(spark, texts):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], DOCS)
    return {r.doc_id: r.class_id for r in near_dups.near_duplicates(df).collect()}


def edit_similarity(a, b):
    """By the whole table of distances, a row at a time: independent of the operator's alignment."""
    codes = {w: k for k, w in enumerate({*a, *b})}
    x, y = np.array([codes[w] for w in a]), np.array([codes[w] for w in b])
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for k, w in enumerate(x, 1):
        new = np.minimum(np.r_[k, row[:-1] + (y != w)], row + 1)
        row = np.minimum.accumulate(new - steps) + steps
    return 1 - row[-1] / max(len(x), len(y), 1)


def test_edit_similarity():
    assert edit_similarity("a b c d".split(), "a c d e f".split()) == 1 - 3 / 5 and edit_similarity(["a"], []) == 0


def test_recall(spark):
    assert near_dups.meeting_probability(0.8) > 0.93 and near_dups.meeting_probability(0.85) > 0.99
    rng = random.Random(1)
    texts, shares = [], (0.2, 0.18, 0.15, 0.1, 0.21)
    for share in shares:
        for n in [200] * 60 + [1000] * 5 + [5000]:
            base = fresh(rng, n)
            texts += [base, changed(rng, base, int(share * n + 1e-9))]
    got = classes(spark, texts)
    pairs = list(zip(texts[::2], texts[1::2], strict=True))
    alike = [edit_similarity(a, b) >= 0.8 - 1e-9 for a, b in pairs]
    assert alike == [True] * 264 + [False] * 66
    met = [got[2 * k + 1] == got[2 * k] for k in range(len(pairs))]
    recall = {share: sum(met[66 * k : 66 * k + 66]) / 66 for k, share in enumerate(shares)}
    assert recall[0.2] >= 0.85 and recall[0.18] >= 0.9 and recall[0.15] >= 0.97 and recall[0.1] == 1 and recall[0.21] == 0
    assert sum(met[:132]) / 132 >= 0.9


def test_recall_of_short_texts(spark):
    assert near_dups.meeting_probability(0.8, near_dups.SHORT_K) > 0.999
    rng = random.Random(4)
    sizes, shares = (10, 20, 40, 100, 140, 180, 500), (0.2, 0.18, 0.15)
    for threshold_texts in (True, False):  # changed words only, and words left out, so that lengths differ
        texts = []
        for n in sizes:
            for share in shares:
                for _ in range(60):
                    base = fresh(rng, n)
                    d = int(share * n + 1e-9)
                    out = sorted(rng.sample(range(n), d))
                    texts += [base, changed(rng, base, d) if threshold_texts else [w for k, w in enumerate(base) if k not in out]]
        got = classes(spark, texts)
        met = np.array([got[2 * k + 1] == got[2 * k] for k in range(len(texts) // 2)]).reshape(len(sizes), len(shares), 60).mean(2)
        assert (met >= 0.9).all(), (threshold_texts, met)


def test_pairs_inside_large_buckets(spark):
    rng = random.Random(2)
    want, texts = {}, []

    def add(text, first=None):
        want[len(texts)] = len(texts) if first is None else first
        texts.append(text)

    for n, pairs in ((1100, 40), (40, 10)):  # a passage of half of each text: all buckets are large, singles are far apart
        passage, start = fresh(rng, 60), len(texts)
        for _ in range(n):
            add(fresh(rng, 30) + passage + fresh(rng, 30))
        for k in range(pairs):
            own = [*range(30), *range(90, 120)]
            at = start + n // 2 + k
            add(changed(rng, texts[at], 6 + k % 19, own), at)  # 0.8 to 0.95
    # a family around one text, and a chain that reaches it by single members only
    base, start = fresh(rng, 100), len(texts)
    for _ in range(60):
        add(changed(rng, base, 6), start)
    link = start + 47
    for _ in range(4):
        nxt = changed(rng, texts[link], 16)
        link = len(texts)
        add(nxt, start)
    assert classes(spark, texts) == want


def test_pairs_of_hot_passages_only(spark, monkeypatch):
    """Texts put together from passages that very many have: no key of a near pair is rare, and its texts are far from leads and
    hubs. Rare words bring together all that buckets leave apart; classes are those of all pairs."""
    monkeypatch.setattr(near_dups, "MOST", 1)
    rng = random.Random(11)
    slots, far = [(fresh(rng, 8), fresh(rng, 8)) for _ in range(16)], lambda x, y: (x ^ y).bit_count() > 3  # 3 slots of 16: 0.81
    codes = []
    while len(codes) < 120:
        x = rng.randrange(1 << 16)
        if all(far(x, y) for y in codes):
            codes.append(x)
    want = dict(enumerate(range(120)))
    for k, x in enumerate(codes[:120]):
        for _ in range(20):
            y = x ^ 1 << rng.randrange(16) ^ 1 << rng.randrange(16)
            if y != x and all(far(y, z) for z in codes if z != x):
                want[len(codes)] = k
                codes.append(y)
                break
    texts = [sum((slots[s][x >> s & 1] for s in range(16)), []) for x in codes]
    assert len(texts) > 130
    got = classes(spark, texts)
    assert got == want
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dups.keep_first(df).collect()) == list(range(120))


def test_texts_fetched_for_a_group_far_from_its_hub(spark, monkeypatch):
    """A text's copies with a twelfth of their words changed, and others with nearly a third, which link with none of them though they share rare
    words. Four times the texts make about four times the rows that fetch texts, not sixteen times."""
    monkeypatch.setattr(near_dups, "MOST", 8)
    made, store, fetch = [], near_dups.store, near_dups._with_texts

    def counted(df, name):
        out = store(df, name)
        made.extend([out.count()] * (name == "tiles"))
        return out

    monkeypatch.setattr(near_dups, "store", counted)
    monkeypatch.setattr(near_dups, "_with_texts", lambda pairs, texts: made.append(pairs.count()) or fetch(pairs, texts))
    rng, rows = random.Random(12), []
    few = [f"w{k}" for k in range(60)]
    base = [rng.choice(few) for _ in range(120)]
    for n in (60, 240):
        texts, shares = [], (10, 36)
        for k in range(n):
            out = list(base)
            for at in rng.sample(range(120), shares[k % 2]):
                out[at] = rng.choice(few)
            texts.append(out)
        made.clear()
        assert classes(spark, texts) == {k: k if k % 2 else 0 for k in range(n)}
        rows.append(sum(made))
    assert rows[1] < 6 * rows[0], rows
