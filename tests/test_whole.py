"""Queries over whole tables against brute force."""

import math
import random
import re

from millwright.operators import cluster, kmeans, resample, sequence
from millwright.plans import catalog

SF = "/root/testdata/sf0.01"


def brute_silhouette(rows):
    """rows of (key, label, x, y)."""
    groups = {}
    for k, g, *p in rows:
        groups.setdefault(g, []).append((k, p))
    total = 0.0
    for k, g, *p in rows:
        means = {h: [math.dist(p, q) for j, q in members if j != k] for h, members in groups.items()}
        means = {h: sum(x) / len(x) for h, x in means.items() if x}
        if g in means:
            a, b = means[g], min(x for h, x in means.items() if h != g)
            total += (b - a) / max(a, b)
    return total / len(rows)


def test_silhouette_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, rng.gauss(i % 3 * 4, 1), rng.gauss(0, 1)) for i in range(60)] + [(60, 7, 9.0, 9.0)]
    points = spark.createDataFrame(rows, "k long, g long, x double, y double")
    got = cluster.silhouette(points, "g", "k", ["x", "y"]).first()
    assert got.n == 61 and abs(got.silhouette - brute_silhouette(rows)) < 1e-9


def test_silhouette_takes_all_embeddings(spark):
    rows = [tuple(r) for r in catalog.points(spark, SF).collect()]
    got = catalog.queries()["silhouette"](spark, SF).first()
    assert "silhouette" not in catalog.oracle_sql()
    assert got.n == len(rows) > 200 and abs(got.silhouette - brute_silhouette(rows)) < 1e-6


def test_natural_order_ranks_every_row(spark):
    names = [None, "b", "a10", "a2", "A1", "a02", "a1b3", "a1b20", "10", "9", ""] + [f"n{i}" for i in range(300, 0, -1)]
    df = spark.createDataFrame(list(enumerate(names)), "k long, name string").repartition(5)
    got = sequence.natural_order(df, "name", "k").collect()
    key = lambda n: [(0, int(x), "") if x.isdigit() else (1, 0, x) for x in re.findall(r"\d+|\D+", (n or "").lower())]
    want = sorted(range(len(names)), key=lambda i: (key(names[i]), i))
    assert [r.k for r in sorted(got, key=lambda r: r.place)] == want
    assert sorted(r.place for r in got) == list(range(1, len(names) + 1))
    assert sequence.natural_order(df.where("false"), "name", "k").count() == 0


def test_natural_order_takes_all_customers(spark):
    got = catalog.queries()["natural_order"](spark, SF)
    assert got.count() == catalog.t(spark, SF, "customer").count() > 50


def test_resampling_queries_draw_the_defaults(spark, monkeypatch):
    import inspect

    drawn = {}
    for of, name, count in ((kmeans, "gap_statistic", "references"), (resample, "bootstrap_mean", "repetitions")):
        plain = inspect.signature(getattr(of, name))
        monkeypatch.setattr(of, name, lambda *a, plain=plain, count=count, name=name, **k: drawn.update({name: (plain.bind(*a, **k).arguments.get(count, plain.parameters[count].default))}))
        catalog.queries()[name](spark, SF)
    assert drawn == {"gap_statistic": 250, "bootstrap_mean": 1000}
