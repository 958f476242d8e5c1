import random
from collections import Counter

import numpy as np
import pytest
from millwright import store
from millwright.llm import near_dedup as nd


def brute(rows, size, percent):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    boss = list(range(len(rows)))

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * len(sets[i] | sets[j]):
                boss[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        c = min(ids, default=None) if sets[i] else d
        out.append((d, len(sets[i]), c, d == c))
    return Counter(out)


def corpus(chains=60):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(5))
    texts = [None, "", " \n", "one", "ONE", "two words", "a b c d", "A b\tC d", "Émile É", "émile é"]
    for _ in range(12):
        texts.append(" ".join(word() for _ in range(rng.randrange(20, 150))))
    for _ in range(60):  # near copies, exact copies
        w = rng.choice(texts[10:22]).split()
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    w = [word() for _ in range(120)]
    for _ in range(chains):  # a chain: neighbours are alike, its ends are not
        w[rng.randrange(len(w))] = word()
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [(None, texts[15]), (None, "alone in the world without id"), rows[3], rows[3]]


@pytest.mark.parametrize("tile, elements", [(2000, 4_000_000), (7, 4_000_000), (2000, 900)])
def test_rows_equal_brute_force(spark, monkeypatch, tile, elements):
    monkeypatch.setattr(nd, "TILE", tile)
    monkeypatch.setattr(nd, "ELEMENTS", elements)
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int").repartition(3)
    got = Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in nd.with_components(docs, 4, 80).collect())
    assert got == brute(rows, 4, 80)


def test_empty_and_stage(spark):
    docs = spark.createDataFrame(corpus(3), "doc_id long, text string")
    assert nd.with_components(docs.where("false")).count() == 0
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    want = Counter({r[0]: 1 for r in brute(corpus(3), 5, 80) if r[3]})
    assert Counter(r.doc_id for r in kept.collect()) == want


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 1 << 63, 60, dtype=np.uint64)])
    x, y = nd.sketch(a), nd.sketch(b)
    assert (nd.merge(x, y) == nd.sketch(np.union1d(a, b))).all()
    equal, more = np.array([(x == y).sum()]), np.array([(x > y).sum()])
    e, possible = nd.estimate(equal, more, nd.REGISTERS - equal - more, np.array([1000]), np.array([960]), 0.8)
    assert abs(e[0] - 900 / 1060) < 0.12 and possible[0]


def test_keep_one_keeps_one_row_without_ids(spark):
    base = [f"w{i}" for i in range(400)]
    near = [" ".join([*base[:i], "changed", *base[i + 1 :]]) for i in (50, 150, 250)]
    other = [" ".join(f"{w}x" if i != k else "changed" for i, w in enumerate(base)) for k in (60, 160)]
    rows = [(None, t) for t in near] + [(5, t) for t in other] + [(None, None), (None, "a lone text of its own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [(r.doc_id, r.text) for r in nd.keep_one(docs).collect()]
    assert len([x for x in kept if x in rows[:3]]) == 1
    assert len([x for x in kept if x in rows[3:5]]) == 1


def test_keep_one_leaves_only_what_its_rows_are_read_from(spark):
    def tables():
        fs, path = store._path(spark, f"{store.shared_dir(spark)}/millwright")
        return {f.getPath().getName() for f in fs.listStatus(path)} if fs.exists(path) else set()

    before = tables()
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(3)
    kept = nd.keep_one(docs, 4, 80)
    left = {t.rsplit("-", 1)[0] for t in tables() - before}
    assert "near-kept" in left and not left & {"near-base", "near-vertices", "near-bands", "near-members", "near-sets", "near-named", "near-links"}
    assert kept.count() > 12
