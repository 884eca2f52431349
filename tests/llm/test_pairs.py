"""Operators on pairs against brute force: embeddings, MinHash, components."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import _common, minhash, vector_join
from sluice.llm.components import components


def join_up(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100 + i, 100) for i in range(1, 30)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)] + [(7, 7), (3, 2)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    want = {n: c for n, c in join_up({x for e in edges for x in e}, edges).items()}
    got = {r.node: r.component for r in components(spark, df).collect()}
    assert all(want[n] == c for n, c in got.items()) and all(want[n] == n for n in want if n not in got)
    assert components(spark, df.limit(0)).count() == 0


def near_vectors(rows, threshold=0.98):
    by = {}
    for i, label, v in rows:
        x = vector_join.usable(v)
        if label is not None and x is not None:
            by.setdefault((label, len(x)), []).append((i, x / np.abs(x).max()))
    edges = []
    for g in by.values():
        for k, (i, x) in enumerate(g):
            for j, y in g[:k]:
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    edges.append((i, j))
    comp = join_up([r[0] for r in rows], edges)
    n = {r[0]: 0 for r in rows}
    for a, b in edges:
        n[a] += 1
        n[b] += 1
    return {i: (n[i], comp[i]) for i in comp}


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(120):
        base = rng.normal(size=20 if k % 2 else 7)
        rows.append((k * 2, k % 3 if k % 11 else None, [float(x) for x in base]))
        rows.append((k * 2 + 1, k % 3, [float(x) for x in base * 2 + rng.normal(size=len(base)) * 0.15]))
    hub = rng.normal(size=16)
    rows += [(1000 + i, 1, [float(x) for x in hub + rng.normal(size=16) * 0.08]) for i in range(90)]  # one dense group, chunk by chunk
    rows += [(2000, 1, None), (2001, 1, []), (2002, 1, [0.0] * 7), (2003, 1, [float("nan")] * 7), (2004, 1, [None, 1.0]), (2005, 1, [1e300] * 7), (2006, 1, [1.0] * 7), (2007, 1, [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("first", F.lit("clash")).withColumn("n_links", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id) for r in vector_join.near_vectors(df, chunk=16).collect()}
    assert got == near_vectors(rows)
    assert vector_join.near_vectors(df.limit(0)).count() == 0


def near_texts(rows, percent=75):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    edges = []
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                edges.append((a, b))
    comp = join_up(ids, edges)
    return {d: (len(sets[d]), comp[d]) for d in ids}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randint(0, 10**6)}"
    return " ".join(words)


def test_minhash_against_all_pairs(spark):
    rng = random.Random(2)
    rows = []
    for _ in range(40):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 50)) for _ in range(rng.choice([3, 5, 6, 8, 12, 30, 100, 300]))]
        rows += [(len(rows) + k, edited(rng, base, rng.randint(0, max(1, len(base) // 25)))) for k in range(rng.choice([2, 5, 12]))]
    base = [f"w{rng.randint(0, 500)}" for _ in range(160)]
    n = len(rows)
    rows += [(n + k, edited(rng, base, rng.randint(1, 6))) for k in range(80)]  # one group about the threshold
    passage = " ".join(f"p{i}" for i in range(60))
    n = len(rows)
    rows += [(n + k, " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(60)) + " " + passage) for k in range(40)]  # a shared passage is no link
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one"), (n + 4, "ONE "), (n + 5, "a b c d"), (n + 6, "one "), (n + 7, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("first", F.lit(0))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()}
    want = near_texts(rows)
    assert got == want
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {d for d, (_, c) in want.items() if d == c}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_one_bit_minima_of_near_sets_differ_little():
    rng = np.random.default_rng(1)
    worst = 0
    for n in (4, 7, 20, 100, 500):
        for _ in range(40):
            s = rng.integers(0, 1 << 63, n * 7 // 6 + 1).astype(np.uint64)
            a, b = np.unique(s[: n + 1]), np.unique(s)
            assert len(a) / len(b) >= 0.75
            bits = minhash.one_bit(minhash.signature(a)) ^ minhash.one_bit(minhash.signature(b))
            worst = max(worst, int(np.unpackbits(bits.view(np.uint8)).sum()))
    assert worst <= minhash.MOST


def test_minhash_refuses_thresholds_its_bands_are_not_made_for(spark):
    df = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    with pytest.raises(ValueError):
        minhash.near_duplicates(df, percent=74)


def shuffled_bytes(spark, group, run):
    """What run() returns, and the bytes that its jobs' stages write to shuffles."""
    sc = spark.sparkContext
    sc.setJobGroup(group, group)
    try:
        out = run()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, track = sc._jsc.sc().statusStore(), sc.statusTracker()
    stages = {i for j in track.getJobIdsForGroup(group) for i in track.getJobInfo(j).stageIds}
    return out, sum(store.lastStageAttempt(i).shuffleWriteBytes() for i in stages)


def test_minhash_shuffles_no_text_that_meets_no_other(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(f"w{rng.randint(0, 10**7)}" for _ in range(1500))) for i in range(400)]
    rows += [(400 + i, edited(rng, rows[i][1].split(), 20)) for i in range(5)] + [(405, rows[7][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got, moved = shuffled_bytes(spark, "minhash-shuffles", lambda: {r.doc_id: r.component_id for r in minhash.near_duplicates(df).collect()})
    assert got == {i: i for i in range(400)} | {400 + i: i for i in range(5)} | {405: 7}
    assert 0 < moved < sum(len(t) for _, t in rows) / 4


@pytest.mark.parametrize("bits", [8, 1 << 26])
def test_a_bitmap_loses_nothing(spark, monkeypatch, bits):
    monkeypatch.setattr(_common, "BITMAP", bits)
    keys = spark.createDataFrame([(i * 7919 - 10**6,) for i in range(0, 3000, 3)], "k long")
    df = spark.createDataFrame([(i * 7919 - 10**6, i) for i in range(3000)], "k long, i int")
    one = _common.bitmap(keys)
    may = {r.i for r in _common.by_bitmap(df, "k", one).collect()}
    surely_not = {r.i for r in _common.by_bitmap(df, "k", one, inside=False).collect()}
    assert may >= set(range(0, 3000, 3)) and may | surely_not == set(range(3000)) and not may & surely_not
    assert len(may) < 1010 or bits == 8


def test_minhash_with_full_bitmaps(spark, monkeypatch):
    monkeypatch.setattr(_common, "BITMAP", 8)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(40))) for i in range(30)]
    rows += [(30 + i, edited(rng, rows[i][1].split(), i % 3)) for i in range(20)] + [(50, rows[4][1]), (51, rows[4][1]), (52, None), (None, rows[4][1])]
    got = [(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id is not None]
    assert dict(got) == {d: c for d, (_, c) in near_texts(rows[:-1]).items()} and len(got) == len(rows) - 1
