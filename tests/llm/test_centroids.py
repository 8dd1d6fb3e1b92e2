import hashlib
import math
import random

import numpy as np
from pyspark.sql import types as T

from tilewright.llm import centroids

SCHEMA = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        *[T.StructField(c, T.StringType()) for c in ("cluster", "v", "upper", "lower", "distance", "scanned")],
    ]
)


def table(spark, rows):
    return spark.createDataFrame([(i, v, *["clash"] * 6) for i, v in rows], SCHEMA).repartition(3)


def vectors(n=600, width=64, blobs=9, seed=1, spread=0.15):
    r = np.random.default_rng(seed)
    at = r.normal(size=(blobs, width))
    return [(i, (at[r.integers(blobs)] + spread * r.normal(size=width)).astype("f4").tolist()) for i in range(n)]


def by_hand(rows, k=8, rounds=10, width=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "~"
    at = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((d2(v, c), j) for j, c in enumerate(at))
    for _ in range(rounds):
        members = [[] for _ in at]
        for _, v in kept:
            members[nearest(v)[1]].append(v)
        at = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(members, at)]
    last = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = [sum(d for _, c, d in last if c == j) for j in range(len(at))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return [(i, c, d, inertia[c], sum(inertia), digests[c]) for i, c, d in last]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def columns(df):
    names = "vec_id cluster distance cluster_inertia inertia centroid_sha256".split()
    return ordered(tuple(r) for r in df.select(*names).collect())


def test_same_as_scanning_everything(spark):
    rows = vectors()
    odd = [None, [], [0.5] * 63, [0.5] * 65, [None] + [0.5] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63]
    rows += [(1000 + i, v) for i, v in enumerate(odd)]
    rows += [(None, rows[3][1]), rows[4], rows[4], *((2000 + i, rows[5][1]) for i in range(200))]
    assert columns(centroids.clustered(table(spark, rows))) == ordered(by_hand(rows))


def test_ties_few_vectors_and_none(spark):
    base = [0.0] * 64
    rows = [(i, [float(x), *base[1:]]) for i, x in enumerate([-2, -1, 0, 1, 2, 1, -1, 0, 0, 2, 5, -5])]
    assert columns(centroids.clustered(table(spark, rows))) == ordered(by_hand(rows))
    few = rows[:3]
    assert columns(centroids.clustered(table(spark, few))) == ordered(by_hand(few))
    same = [(i, base) for i in range(20)]
    assert columns(centroids.clustered(table(spark, same))) == ordered(by_hand(same))
    assert centroids.clustered(table(spark, [])).count() == 0
    assert centroids.clustered(table(spark, [(1, None)])).count() == 0


def test_other_width_scale_and_rounds(spark):
    rows = vectors(200, width=3, blobs=4, spread=0.4)
    _, found, scans = centroids.cluster(table(spark, rows), k=4, rounds=6, width=3)
    assert len(found) == 4 and len(scans) == 7
    assert scans[0] == 200 and min(scans[1:]) < 80  # bounds spare most vectors once centroids settle


def test_approach_bounds_every_vector_of_the_sphere_and_is_tighter_than_drift():
    r = np.random.default_rng(5)
    spared = 0.0
    for _ in range(200):
        width = int(r.integers(2, 6))
        old = r.normal(size=(4, width)) * 10
        new = old + r.normal(size=(4, width)) * r.choice([0.1, 1, 5])
        radius = r.uniform(0.1, 9, 4)
        bound = centroids.approach(old, new, radius)
        drift = np.sqrt(np.square(new - old).sum(axis=1))
        assert (bound <= drift[None] + 1e-9).all()
        spared += (drift[None] - bound).sum()
        for a in range(4):
            x = r.normal(size=(400, width))
            x = old[a] + x / np.linalg.norm(x, axis=1)[:, None] * radius[a] * r.uniform(0, 1, (400, 1)) ** (1 / width)
            nearer = np.linalg.norm(x[:, None] - old, axis=2) - np.linalg.norm(x[:, None] - new, axis=2)
            assert (nearer <= bound[a] + 1e-9).all()
    assert spared > 0


def test_bounds_of_a_round_hold():
    r, random_ = np.random.default_rng(7), random.Random(7)
    v = (np.array([x for _, x in vectors(500, 8, 5)]) * 1024).astype("i8")
    at = v[random_.sample(range(500), 5)]
    cluster, upper, lower, _ = centroids.assign(v, None, None, None, centroids.Shift(at))
    for _ in range(8):
        moved = np.stack([v[cluster == j].sum(axis=0) // max((cluster == j).sum(), 1) for j in range(5)])
        reach = np.array([upper[cluster == j].max(initial=0) for j in range(5)])
        drift = np.sqrt(np.square((moved - at).astype("f8")).sum(axis=1))
        shift = centroids.Shift(moved, drift, centroids.loosening(at, moved, reach))
        at = moved
        cluster, upper, lower, _ = centroids.assign(v, cluster, upper, lower, shift)
        d = np.sqrt(centroids.squared(v, at).astype("f8"))
        assert (cluster == d.argmin(axis=1)).all() and (upper >= d.min(axis=1)).all()
        others = d.copy()
        others[np.arange(500), cluster] = np.inf
        assert (lower <= others.min(axis=1) * (1 + 1e-12)).all()
