import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from symgraph.llm.centroids import cluster, exact_nearest, nearest, op11_centroid_clustering, screened


def brute(rows, dim, k, rounds, seed=2):
    """rows (id, components) -> sorted (id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    for _ in range(rounds):
        own = [exact_nearest(v, centroids)[0] for _, v in kept]
        for j in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [exact_nearest(v, centroids) for _, v in kept]
    inertia = [sum(d for j, d in found if j == c) for c in range(len(centroids))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    long = lambda x: x if x < 1 << 63 else None
    return sorted(((i, j, long(d), long(inertia[j]), long(sum(inertia)), digest[j]) for (i, _), (j, d) in zip(kept, found)), key=str)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_intervals_hold_and_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(1)
    for scale in (3, 200, 1 << 15, (1 << 26) - 1):
        v, c = rng.integers(-scale, scale + 1, (200, 64)), rng.integers(-scale, scale + 1, (17, 64))
        c[5] = c[2]  # a tie for every vector that these two are nearest to
        c[9] = v[0]
        c[11] = v[0]
        low, high = screened(v, c)
        best, far = nearest(v, c)
        for i in range(len(v)):
            x = v[i].tolist()
            own = sum(a * a for a in x)
            for j in range(len(c)):
                true = sum((a - b) ** 2 for a, b in zip(x, c[j].tolist())) - own
                assert Fraction(float(low[i, j])) <= true <= Fraction(float(high[i, j]))
            assert (best[i], far[i]) == exact_nearest(x, c.tolist())
        assert best[0] == 9 and 5 not in best


def test_vectors_just_apart_are_told_apart():
    """Distances that differ by one unit at a size where float32 cannot see it."""
    base = [1 << 20] * 64
    v = np.array([base], np.int64)
    near, nearer = [[x + 1000 for x in base] for _ in range(2)]
    near[0] += 1
    assert nearest(v, np.array([near, nearer], np.int64))[0].tolist() == [1]
    assert nearest(v, np.array([nearer, near], np.int64))[0].tolist() == [0]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_same_as_brute_force(spark, kind):
    """Nulls, wrong lengths, ties, repeated rows, other columns, and values of any size."""
    rng = random.Random(4)
    single = lambda x: float(np.float32(x)) if kind == "float" else x
    rows = [(i, [single(rng.gauss(0, 1)) for _ in range(6)]) for i in range(120)] + [(i, [0.5] * 6) for i in range(200, 206)]
    rows += [(7, [single(0.25)] * 6)] * 3 + [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 7), (304, [1.0, None, 1.0, 1.0, 1.0, 1.0])]
    rows += [(305, [float("nan")] + [1.0] * 5), (306, [1.0] * 5 + [float("inf")]), (307, [-float("inf")] * 6), (None, [single(0.1)] * 6)]
    rows += [(400, [single(1000.7)] * 6), (401, [single(-300000.3)] * 6), (402, [single(2.0**40 + 0.3)] + [single(0.3)] * 5)]
    large = [(403, [single(3e30), single(-1e20)] + [0.1] * 4), (404, [single(-3e30)] * 6)]
    schema = f"vec_id long, embedding array<{kind}>, cluster string, v int"
    for use, k in ((rows, 8), (rows + large, 8), (rows[:3], 8)):
        df = spark.createDataFrame([(*r, "c", 1) for r in use], schema).repartition(3)
        use = [(i, v if v is None else [x if x is None else single(x) for x in v]) for i, v in use]
        found, _ = cluster(df, dim=6, k=k, rounds=3)
        assert got(found) == brute(use, 6, k, 3)
    assert cluster(spark.createDataFrame([], schema), dim=6)[0].count() == 0


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/sf{sf}/embeddings.parquet").collect()]
    assert got(op11_centroid_clustering(spark, f"/root/testdata/sf{sf}")) == brute(rows, 64, 40, 5)
