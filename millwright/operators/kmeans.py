"""k-means with seeding and restarts, all trials in the same jobs.

A trial is a (set, k, restart). Each job reads the distinct points with their weights once and works on every
trial that is still running: a seeding job finds each trial's next centre, a round gives each (trial, centre)
its sums. Tasks hand on a row a trial or centre; the driver holds centres only, whose number is set by
parameters, never by the points. Draws are hashes of (point, trial, step, seed): they don't depend on how the
points are spread, and a lost task draws the same again.
"""

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.store import Cut

#: Numbers that a task works on at once: rows x trials x centres x dimensions.
AT_ONCE = 1 << 21


@dataclass
class Trial:
    """``seeds`` while being seeded; then ``centres``, and the centres ``by`` which their members were told."""

    set: int
    k: int
    restart: int
    centres: list = field(default_factory=list)
    by: list | None = None
    told: bool = False
    done: bool = False

    @property
    def key(self):
        return self.set, self.k, self.restart


@dataclass
class Fit:
    """The best trial: inertia, centres in canonical order (by sum, then coordinates) and their sizes."""

    inertia: float
    centres: list
    sizes: list


def uniform(h: np.ndarray, trial: tuple, step: int, seed: int) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes of points, for one step of one trial."""
    mixed = seed
    for x in (*trial, step):
        mixed = (mixed * 0x9E3779B97F4A7C15 + x + 1) & (2**64 - 1)
    z = h.astype(np.uint64) ^ np.uint64(mixed)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return ((z >> np.uint64(11)).astype(float) + 0.5) / 2.0**53


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """(row, trial, centre): squared distances to (trial, centre, dimension)."""
    return ((x[:, None, None, :] - centres[None]) ** 2).sum(-1)


def weighted(points: DataFrame, dims: list[str], sets: str | None = None) -> DataFrame:
    """(set, x0, x1, ..., w, h): distinct points with their number and a hash. Rows with a null or NaN coordinate don't count."""
    names = [f"x{i}" for i in range(len(dims))]
    rows = points.select((F.col(sets).cast("long") if sets else F.lit(0).cast("long")).alias("set"), *[(F.col(d).cast("double") + F.lit(0.0)).alias(n) for d, n in zip(dims, names, strict=True)])
    rows = rows.dropna()
    return rows.groupBy("set", *names).agg(F.count("*").cast("double").alias("w")).withColumn("h", F.xxhash64(*names))


def _each(table: DataFrame, dims: int, trials: list[Trial], centres, work, schema: str) -> DataFrame:
    """Rows that ``work(x, w, h, trials of one set and k, their centres)`` gives for parts of one set's points."""
    groups: dict = {}
    for t in trials:
        groups.setdefault(t.set, {}).setdefault(t.k, []).append(t.key)
    held = {t.key: np.asarray(centres(t), float).reshape(-1, dims) for t in trials}
    names = [p.split()[0] for p in schema.split(", ")]

    def run(batches):
        for batch in batches:
            column = {n: batch.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(batch.schema.names)}
            points = np.stack([column[f"x{i}"] for i in range(dims)], 1)
            out = []
            for one in np.unique(column["set"]):
                at = np.flatnonzero(column["set"] == one)
                for k, keys in groups.get(int(one), {}).items():
                    c = np.stack([held[key] for key in keys])
                    step = max(1, AT_ONCE // max(1, len(keys) * max(1, c.shape[1]) * dims))
                    for a in range(0, len(at), step):
                        part = at[a : a + step]
                        out += work(points[part], column["w"][part], column["h"][part], k, keys, c)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*out, strict=True)], names=names)

    return table.select("set", *[f"x{i}" for i in range(dims)], "w", "h").mapInArrow(run, schema)


_KEY = "set long, k long, restart long"


def _seed(table: DataFrame, dims: int, trials: list[Trial], step: int, seed: int) -> None:
    """One more centre for each trial: a point drawn with a chance proportional to its weight times the squared distance
    from the nearest centre so far (its weight alone at first).

    The least -log(u) / weight wins: such a race draws by weight without any sum over the points.
    """
    xs = [f"x{i}" for i in range(dims)]

    def work(x, w, h, k, keys, c):
        out = []
        far = squared(x, c).min(2) if c.shape[1] else np.ones((len(x), len(keys)))
        for j, key in enumerate(keys):
            live = np.flatnonzero(far[:, j] > 0)
            if len(live):
                cost = -np.log(uniform(h[live], key, step, seed)) / (w[live] * far[live, j])
                first = live[np.lexsort((h[live], cost))[0]]
                out.append((*key, float(cost.min()), int(h[first]), *map(float, x[first])))
        return out

    schema = f"{_KEY}, cost double, h long, " + ", ".join(f"{x} double" for x in xs)
    raced = _each(table, dims, trials, lambda t: t.centres, work, schema)
    won = raced.groupBy("set", "k", "restart").agg(F.min(F.struct("cost", "h", *xs)).alias("m")).collect()
    found = {(r["set"], r["k"], r["restart"]): [r["m"][x] for x in xs] for r in won}
    for t in trials:
        if t.key in found:
            t.centres.append(found[t.key])
        else:
            t.done = True  # fewer distinct points than centres


def _round(table: DataFrame, dims: int, trials: list[Trial]) -> None:
    """Every trial's points told anew and its centres moved. It is done when no point changes its centre, or when one
    is left without points, which undoes the round."""
    sums = [f"s{i}" for i in range(dims)]

    def work(x, w, h, k, keys, c):
        now, before = c[:, :k], c[:, k:]
        label, out = squared(x, now).argmin(2), []
        old = squared(x, before).argmin(2)
        for j, key in enumerate(keys):
            moved = float(w[label[:, j] != old[:, j]].sum())
            total = np.bincount(label[:, j], w, k)
            parts = [np.bincount(label[:, j], w * x[:, d], k) for d in range(dims)]
            out += [(*key, i, float(total[i]), moved if i == first else 0.0, *[float(p[i]) for p in parts]) for first in [int(np.flatnonzero(total)[0])] for i in np.flatnonzero(total).tolist()]
        return out

    schema = f"{_KEY}, c long, w double, moved double, " + ", ".join(f"{s} double" for s in sums)
    told = _each(table, dims, trials, lambda t: t.centres + (t.by or t.centres), work, schema)
    got: dict = {}
    for r in told.groupBy("set", "k", "restart", "c").agg(F.sum("w").alias("w"), F.sum("moved").alias("moved"), *[F.sum(s).alias(s) for s in sums]).collect():
        got.setdefault((r["set"], r["k"], r["restart"]), {})[r["c"]] = r
    for t in trials:
        rows = got[t.key]
        if len(rows) < t.k:
            t.done = True
            continue
        means = [[rows[c][s] / rows[c]["w"] for s in sums] for c in range(t.k)]
        t.done = t.by is not None and sum(r["moved"] for r in rows.values()) == 0
        t.by, t.centres, t.told = t.centres, means, True


def _inertia(table: DataFrame, dims: int, trials: list[Trial]) -> dict:
    def work(x, w, h, k, keys, c):
        label = squared(x, c[:, k:]).argmin(2)
        out = []
        for j, key in enumerate(keys):
            off = ((x - c[j, :k][label[:, j]]) ** 2).sum(1) * w
            total, each = np.bincount(label[:, j], w, k), np.bincount(label[:, j], off, k)
            out += [(*key, i, float(total[i]), float(each[i])) for i in range(k)]
        return out

    told = _each(table, dims, trials, lambda t: t.centres + t.by, work, f"{_KEY}, c long, w double, off double")
    got: dict = {}
    for r in told.groupBy("set", "k", "restart", "c").agg(F.sum("w").alias("w"), F.sum("off").alias("off")).collect():
        got.setdefault((r["set"], r["k"], r["restart"]), {})[r["c"]] = (r["w"], r["off"])
    return got


def fit_all(points: DataFrame, dims: list[str], ks: list[int], restarts: int = 32, rounds: int = 150, seed: int = 1729, sets: str | None = None) -> dict[tuple[int, int], Fit]:
    """(set, k) -> Fit, the trial of least inertia (the first on ties) of ``restarts`` for each set and each k.

    A trial stops when no point changes its centre, after ``rounds`` rounds, or when a centre loses all its
    points, which undoes that round; one that loses a centre at once, or that finds too few distinct
    points to be seeded with, doesn't count. Without any trial that counts, a (set, k) is missing.
    """
    if min(ks, default=0) < 1:
        raise ValueError("k starts at 1")
    kept = Cut(weighted(points, dims, sets), "kmeans-points")
    n = len(dims)
    found = [r["set"] for r in kept.df.select("set").distinct().collect()]  # sets are a parameter: one, or one a reference
    trials = [Trial(s, k, r) for s in sorted(found) for k in ks for r in range(restarts)]
    for step in range(max(ks)):
        _seed(kept.df, n, [t for t in trials if not t.done and t.k > step], step, seed)
    for _ in range(rounds):
        live = [t for t in trials if not t.done]
        if not live:
            break
        _round(kept.df, n, live)
    good = [t for t in trials if t.told]
    costs = _inertia(kept.df, n, good) if good else {}
    kept.drop()
    best: dict = {}
    for t in good:
        inertia = math.fsum(off for _, off in costs[t.key].values())
        if (t.set, t.k) not in best or inertia < best[t.set, t.k].inertia:
            order = sorted(range(t.k), key=lambda c: (sum(t.centres[c]), t.centres[c]))
            best[t.set, t.k] = Fit(inertia, [t.centres[c] for c in order], [int(costs[t.key][c][0]) for c in order])
    return best


def fit(points: DataFrame, dims: list[str], k: int, restarts: int = 32, rounds: int = 150, seed: int = 1729) -> Fit:
    """The best of ``restarts`` k-means of the points; ValueError if there are fewer distinct points than ``k``."""
    found = fit_all(points, dims, [k], restarts, rounds, seed)
    if (0, k) not in found:
        raise ValueError(f"cannot fit k={k} to so few distinct points")
    return found[0, k]


def centres(points: DataFrame, dims: list[str], k: int, **options) -> DataFrame:
    """(c, dims, n, inertia) of ``fit``, c from 0 in canonical order; also what ``cluster.assign`` takes."""
    got = fit(points, dims, k, **options)
    rows = [(c, *x, n, got.inertia) for c, (x, n) in enumerate(zip(got.centres, got.sizes, strict=True))]
    return points.sparkSession.createDataFrame(rows, "c int, " + ", ".join(f"{d} double" for d in dims) + ", n long, inertia double")


def gap_statistic(points: DataFrame, dims: list[str], max_k: int = 6, references: int = 250, restarts: int = 48, reference_restarts: int = 6, seed: int = 0) -> DataFrame:
    """k, log_inertia, gap, se, chosen: the smallest k with Gap(k) >= Gap(k+1) - se(k+1), else the largest.

    References are sets of as many points, uniform in the points' bounding box, drawn by hash of their number;
    they are made in Spark and fitted together, as sets of the same jobs. k stays below the number of points
    and at most that of distinct points. No points give no rows.
    """
    spark = points.sparkSession
    own = points.select(*[F.col(d).cast("double").alias(f"x{i}") for i, d in enumerate(dims)]).dropna()
    names = own.columns
    box = own.agg(F.count("*").alias("n"), *[f(x).alias(f"{x}_{w}") for x in names for f, w in ((F.min, "low"), (F.max, "high"))]).first()
    distinct = own.distinct().count()
    ks = list(range(1, min(max_k, distinct, max(1, box["n"] - 1)) + 1))
    empty = spark.createDataFrame([], "k int, log_inertia double, gap double, se double, chosen boolean")
    if not box["n"]:
        return empty
    u = lambda i: F.pmod(F.xxhash64("id", F.lit(i), F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)
    drawn = spark.range(references * box["n"]).select(F.floor(F.col("id") / box["n"]).alias("set"), *[(F.lit(box[f"{x}_low"]) + (box[f"{x}_high"] - box[f"{x}_low"]) * u(i)).alias(x) for i, x in enumerate(names)])
    told = fit_all(own, names, ks, restarts, seed=seed + 4000)
    by_chance = fit_all(drawn, names, ks, reference_restarts, seed=seed + 200_000, sets="set")
    log = lambda f: math.log(max(f.inertia, 1e-300))
    rows = []
    for k in ks:
        logs = [log(by_chance[s, k]) for s in range(references) if (s, k) in by_chance]
        mean = math.fsum(logs) / len(logs)
        sd = math.sqrt(math.fsum((x - mean) ** 2 for x in logs) / (len(logs) - 1)) if len(logs) > 1 else 0.0
        rows.append((k, log(told[0, k]), mean - log(told[0, k]), sd * math.sqrt(1 + 1 / references)))
    chosen = next((a[0] for a, b in zip(rows, rows[1:], strict=False) if a[2] >= b[2] - b[3]), ks[-1])
    return spark.createDataFrame([(*r, r[0] == chosen) for r in rows], empty.schema)
