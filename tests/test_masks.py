"""Mask components against a flood fill, pixel by pixel."""

import random

from millwright.operators import masks
from millwright.store import cut

SCHEMA = "image int, y int, x int, on boolean"


def flood(grid, diagonal):
    """{(y, x): first pixel of its component} of a dict of pixels."""
    steps = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (diagonal or not a * b)]
    label = {}
    for start in sorted(grid):
        if start not in label:
            label[start], todo = start, [start]
            while todo:
                y, x = todo.pop()
                for a, b in steps:
                    p = (y + a, x + b)
                    if p in grid and p not in label and grid[p] == grid[start]:
                        label[p] = start
                        todo.append(p)
    return label


def flipped(grid, diagonal, chosen):
    label = flood(grid, diagonal)
    members = {}
    for p, at in label.items():
        members.setdefault(at, []).append(p)
    out = dict(grid)
    for at, own in members.items():
        if chosen(grid[at], own):
            out |= {p: not grid[at] for p in own}
    return out


def spiral(n):
    grid, y, x, dy, dx = {(i, j): False for i in range(n) for j in range(n)}, 0, 0, 0, 1
    grid[0, 0] = True
    while True:
        for _ in range(2):
            ahead, beyond = (y + dy, x + dx), (y + 2 * dy, x + 2 * dx)
            if ahead in grid and not grid.get(beyond, False):
                break
            dy, dx = dx, -dy
        else:
            return grid
        y, x = ahead
        grid[y, x] = True


def images():
    rng = random.Random(6)
    made = [{(y, x): rng.random() < share for y in range(h) for x in range(w)} for h, w, share in ((8, 8, 0.5), (12, 150, 0.6), (30, 9, 0.4), (1, 70, 0.5), (9, 1, 0.7), (20, 20, 0.05), (20, 20, 0.97))]
    made += [{(y, x): (y + x) % 2 == 0 for y in range(10) for x in range(140)}, spiral(13), {(y, x): False for y in range(3) for x in range(3)}, {(0, 0): True}]
    holed = {(y, x): rng.random() < 0.5 for y in range(15) for x in range(15)}
    return [*made, {p: v for p, v in holed.items() if rng.random() < 0.9}]  # some pixels are missing


def test_equals_flood_fill(spark):
    grids = images()
    rows = [(i, y, x, v) for i, g in enumerate(grids) for (y, x), v in g.items()]
    rows += [(0, None, 1, True), (0, 1, None, True), (0, 0, 0, grids[0][0, 0]), (99, 5, 5, None)]
    grids_by = dict(enumerate(grids)) | {99: {(5, 5): False}}
    df = cut(masks.runs(spark.createDataFrame(rows, SCHEMA).repartition(4), ["image"]), "runs")

    def read(runs):
        out = {}
        for r in masks.pixels(runs, ["image"]).collect():
            out.setdefault(r.image, {})[r.y, r.x] = r.on
        return out

    assert read(df) == grids_by
    for diagonal in (True, False):
        got = {}
        for r in masks.labelled(df, ["image"], diagonal).collect():
            got.setdefault(r.image, {}).update({(r.y, x): tuple(r.label) for x in range(r.x0, r.x1 + 1)})
        assert got == {i: flood(g, diagonal) for i, g in grids_by.items()}
    small = lambda colour: lambda on, own: on == colour and len(own) < 4
    assert read(masks.area_filtered(df, ["image"], 4)) == {i: flipped(flipped(g, True, small(True)), True, small(False)) for i, g in grids_by.items()}
    assert read(masks.filled(df, ["image"])) == {i: flipped(g, False, lambda on, own, g=g: not on and min(own)[0] > min(g)[0]) for i, g in grids_by.items()}

    def interior(g):
        low = max(y for y, _ in g) - 3
        reaches = lambda own: max(y for y, _ in own) > low
        label = flood(g, True)
        some = any(g[p] and p[0] > low for p in label)
        return flipped(g, True, lambda on, own: on and some and not reaches(own))

    assert read(masks.interior_connected(df, ["image"])) == {i: interior(g) for i, g in grids_by.items()}


def test_empty_table(spark):
    none = masks.runs(spark.createDataFrame([], SCHEMA), ["image"])
    assert masks.components(none, ["image"]).count() == masks.filled(none, ["image"]).count() == masks.area_filtered(none, ["image"], 3).count() == 0
