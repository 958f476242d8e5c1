"""Masked correlation surfaces against a loop over pixels."""

import math
import random

import pytest
from millwright.operators import translation

SCHEMA = "image int, y int, x int, v double"


def plain(a, b, limit, least, share):
    out = {}
    for dy in range(-limit, limit + 1):
        for dx in range(-limit, limit + 1):
            both = [(v, b[y + dy, x + dx]) for (y, x), v in a.items() if (y + dy, x + dx) in b]
            n, score = len(both), None
            if n >= max(least, share * len(a)):
                ma, mb = (sum(p[i] for p in both) / n for i in (0, 1))
                va, vb = sum((p[0] - ma) ** 2 for p in both), sum((p[1] - mb) ** 2 for p in both)
                score = sum((p[0] - ma) * (p[1] - mb) for p in both) / math.sqrt(va * vb) if va * vb > 1e-20 else None
            out[dy, dx] = n, score
    return out


def images():
    rng = random.Random(10)
    noise = {(y, x): rng.random() for y in range(-12, 40) for x in range(-12, 40)}
    cut = lambda h, w, dy=0, dx=0, keep=1.0: {(y, x): noise[y - dy, x - dx] for y in range(h) for x in range(w) if rng.random() < keep}
    return {
        0: (cut(8, 8), cut(8, 8, 1, -2)), 1: (cut(20, 17, keep=0.8), cut(20, 17, 3, 2, keep=0.7)), 2: (cut(8, 8, keep=0.15), cut(8, 8)),
        3: ({(y, x): 0.5 for y in range(8) for x in range(8)}, cut(8, 8)), 4: (cut(8, 8), {}), 5: (cut(9, 30), cut(9, 30, -3, 3)),
    }


@pytest.mark.parametrize("tile", [5, 64])
def test_equals_loops(spark, tile):
    given = images()
    frame = lambda i: spark.createDataFrame([(k, y, x, v) for k, p in given.items() for (y, x), v in p[i].items()] + [(0, None, 1, 1.0), (1, 0, None, 1.0), (2, 1, 1, None) if i else (None, 1, 1, 1.0)], SCHEMA).repartition(3)
    got = translation.surface(frame(0), frame(1), ["image"], 3, least=10, share=0.3, tile=tile)
    found = {}
    for r in got.collect():
        found.setdefault(r.image, {})[r.dy, r.dx] = r.overlap, r.score
    assert sorted(found) == sorted(given)
    for k, (a, b) in given.items():
        want = plain(a, b, 3, 10, 0.3)
        assert {s: v[0] for s, v in found[k].items()} == {s: v[0] for s, v in want.items()}
        for s, (_, score) in want.items():
            assert (found[k][s][1] is None) == (score is None) and (score is None or found[k][s][1] == pytest.approx(score, abs=1e-9))
    best = {r.image: (r.dy, r.dx) for r in translation.best_shift(got, ["image"]).collect()}
    assert best == {0: (1, -2), 1: (3, 2), 2: best[2], 3: (None, None), 4: (None, None), 5: (-3, 3)}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert translation.surface(none, none, ["image"], 2).count() == 0
