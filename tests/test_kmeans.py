"""k-means with restarts against a plain one that takes the same draws."""

import math
import random

import numpy as np
import pytest
from millwright.operators import kmeans
from millwright.plans import catalog

SF = "/root/testdata/sf0.01"


def plain(points, hashes, weights, k, restarts, seed, which=0):
    """points, their hashes and weights -> best (inertia, centres): point by point, trial by trial."""
    best = None
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda p, cs: min(range(len(cs)), key=lambda c: d2(p, cs[c]))
    for restart in range(restarts):
        centres = []
        for step in range(k):
            u = kmeans.uniform(np.array(hashes), (which, k, restart), step, seed)
            far = [min((d2(p, c) for c in centres), default=1.0) for p in points]
            race = [(-math.log(a) / (w * f), h, p) for a, w, f, h, p in zip(u, weights, far, hashes, points) if f > 0]
            if not race:
                break
            centres.append(min(race)[2])
        if len(centres) < k:
            continue
        labels = None
        for _ in range(150):
            new = [nearest(p, centres) for p in points]
            if len(set(new)) < k:
                break
            groups = [[(p, w) for p, w, x in zip(points, weights, new) if x == c] for c in range(k)]
            centres = [tuple(sum(w * p[d] for p, w in g) / sum(w for _, w in g) for d in range(len(p0))) for g in groups for p0 in [g[0][0]]]
            same, labels = labels == new, new
            if same:
                break
        if labels is None:
            continue
        inertia = sum(w * d2(p, centres[x]) for p, w, x in zip(points, weights, labels))
        if best is None or inertia < best[0]:
            best = inertia, sorted(centres, key=lambda c: (sum(c), c))
    return best


def check(spark, df, dims, k, restarts, seed=5):
    rows = kmeans.weighted(df, dims).collect()
    points = [tuple(r[f"x{i}"] for i in range(len(dims))) for r in rows]
    want = plain(points, [r.h for r in rows], [r.w for r in rows], k, restarts, seed)
    got = kmeans.fit(df, dims, k, restarts, seed=seed)
    assert got.inertia == pytest.approx(want[0], rel=1e-9, abs=1e-9)
    assert np.allclose(got.centres, want[1], rtol=1e-9, atol=1e-9)
    assert sum(got.sizes) == sum(r.w for r in rows)


def test_equals_plain(spark):
    rng = random.Random(2)
    blobs = [(rng.gauss(c % 3 * 4, 1), rng.gauss(c // 3 * 3, 1), "x") for c in range(5) for _ in range(30)]
    rows = blobs + blobs[:20] + [(0.0, 0.0, "tie")] * 9 + [(None, 1.0, "null"), (math.nan, 1.0, "nan")]
    df = spark.createDataFrame(rows, "a double, b double, w string").repartition(5)
    for k, restarts in ((1, 2), (3, 4), (5, 32)):
        check(spark, df, ["a", "b"], k, restarts)


def test_embeddings(spark):
    """The query's points, all of them."""
    check(spark, catalog.points(spark, SF), ["x", "y"], 4, 3, seed=1729)


def test_few_points(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,)], "a double")
    assert kmeans.fit(df, ["a"], 2).centres == [[1.0], [2.0]] and kmeans.fit(df, ["a"], 2).sizes == [2, 1]
    with pytest.raises(ValueError):
        kmeans.fit(df, ["a"], 3)
    with pytest.raises(ValueError):
        kmeans.fit(df.where("false"), ["a"], 1)


def test_planted_clusters_are_found_and_counted(spark):
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.gauss(c * 9, 0.4), rng.gauss(c % 2 * 9, 0.4)) for c in range(3) for _ in range(40)], "a double, b double")
    got = kmeans.gap_statistic(df, ["a", "b"], max_k=4, references=12, restarts=8).collect()
    assert [r.k for r in got if r.chosen] == [3] and [r.k for r in got] == [1, 2, 3, 4]
    alone = spark.createDataFrame([(1.0, 2.0)], "a double, b double")
    assert [(r.k, r.chosen) for r in kmeans.gap_statistic(alone, ["a", "b"], references=3, restarts=2).collect()] == [(1, True)]
    assert kmeans.gap_statistic(df.where("false"), ["a", "b"], references=3).count() == 0
