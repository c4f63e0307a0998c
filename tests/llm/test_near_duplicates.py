"""HyperMinHash near-duplicates against brute force, with hot groups and odd rows."""

import numpy as np
import pytest
from pyspark.sql import types as T

from ledgerloom.llm import hyperminhash as H
from ledgerloom.llm.components import components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.StringType())])


def brute(rows, words, percent):
    sets = {}
    for i, t in rows:
        if i is not None:
            w = (t or "").encode().lower().split()
            k = min(words, len(w))
            sets.setdefault(i, []).append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set())
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x in range(len(ids)):
        for y in range(x):
            for a in sets[ids[x]]:
                for b in sets[ids[y]]:
                    c = len(a & b)
                    if a and b and 100 * c >= percent * (len(a) + len(b) - c):
                        p, q = find(ids[x]), find(ids[y])
                        root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


def corpus(seed, base_words=60, copies=120):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = list(rng.choice(vocab, base_words))
    rows = [(i, " ".join(rng.choice(vocab, int(rng.integers(3, 60))))) for i in range(1, 40)]
    for i in range(100, 100 + copies):  # near copies around the threshold
        t = list(base)
        for _ in range(int(rng.integers(0, 7))):
            t[int(rng.integers(len(t)))] = str(rng.choice(vocab))
        rows.append((i, " ".join(t)))
    rows += [(i, "same exact text here") for i in range(500, 530)]
    rows += [(600, None), (601, ""), (602, " \n\t "), (603, "one"), (604, "ONE"), (605, "one two"), (606, "one\x0btwo"), (None, "one two"), (100, rows[39][1])]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "clash") for i, t in rows], SCHEMA)
    got = H.near_duplicates(df, words=2, percent=80).collect()
    assert len(got) == len(rows)
    want = brute(rows, 2, 80)
    assert {r.id: r.root for r in got if r.id is not None} == want
    assert all(r.root is None for r in got if r.id is None)


def test_empty_table(spark):
    assert H.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_estimate_is_close():
    rng = np.random.default_rng(0)
    for common, extra in ((800, 100), (400, 300), (50, 5)):
        shared = rng.integers(0, 1 << 63, common, dtype=np.uint64)
        a, b = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, extra, dtype=np.uint64)])) for _ in range(2))
        r = H.registers(np.concatenate([a, b]), np.array([0, len(a)]), 378)
        j = H.estimate(r[:1], r[1:], np.array([len(a)]), np.array([len(b)]))[0]
        assert abs(j - common / (common + 2 * extra)) < 0.12


def test_chance_agreement_matches_simulation():
    rng = np.random.default_rng(1)
    hits = []
    for _ in range(60):
        a, b = rng.integers(0, 1 << 63, 100, dtype=np.uint64), rng.integers(0, 1 << 63, 140, dtype=np.uint64)
        r = H.registers(np.concatenate([a, b]), np.array([0, 100]), 2000)
        hits.append((r[0] == r[1]).mean())
    assert abs(np.mean(hits) - H.chance_agreement(np.array([100]), np.array([140]))[0]) < 3e-4


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(200, 200)]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {k: 100 for k in range(101, 160)}


def test_components_equal_a_plain_search(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (330, 2))] + [(500, k) for k in range(400, 500)] + [(k, 600) for k in range(601, 700)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    root = {}
    for i in sorted(near):
        todo = [i]
        while todo:
            j = todo.pop()
            if j not in root:
                root[j] = i
                todo += near[j]
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: r for i, r in root.items() if i != r}


@pytest.mark.parametrize("share", [0.68, 0.74])
def test_clusters_that_share_buckets(spark, share):
    """Clusters of near copies whose centres are alike, but less than the threshold: links between them are rare or none."""
    rng = np.random.default_rng(int(100 * share))
    vocab = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(vocab, 120, replace=False))
    rows, i = [], 0
    for k in range(3):
        own = list(base)
        for j in range(int(120 * (1 - share) / (1 + share) / 2)):
            own[(7 * k + j) % 120] = f"c{k}x{j}"
        for _ in range(70):
            t = list(own)
            for _ in range(int(rng.integers(0, 5))):
                t[int(rng.integers(120))] = str(rng.choice(vocab))
            rows.append((i, " ".join(t)))
            i += 1
    got = H.near_duplicates(spark.createDataFrame([(i, t, "") for i, t in rows], SCHEMA), words=2, percent=80).collect()
    assert {r.id: r.root for r in got} == brute(rows, 2, 80)


def test_very_long_texts(spark):
    words = [f"w{i * 7919 % 100_003}" for i in range(150_000)]
    base = " ".join(words)
    near = " ".join(w if i % 40 else "x" + w for i, w in enumerate(words))  # every fortieth word another: 0.9 alike
    far = " ".join(w if i % 4 else "y" + w for i, w in enumerate(words))
    rows = [(5, base, ""), (3, near, ""), (9, far, ""), (7, base, ""), (1, "no space " + "z" * 1_000_000, "")]
    got = {r.id: r.root for r in H.near_duplicates(spark.createDataFrame(rows, SCHEMA), words=2, percent=80).collect()}
    assert got == {5: 3, 3: 3, 7: 3, 9: 9, 1: 1}
