import hashlib
import random

from millwright.llm import fingerprints as fp


def test_tree_locates_edits():
    text = "one two\nthree four\n\nfive six\nseven eight"
    a, b = fp.fingerprint(text), fp.fingerprint(text.replace("six", "sixty"))
    assert a != b and fp.fingerprint(text) == a
    assert fp.differing(a, b) == ([(1, 0)], [(1, 0)])
    assert fp.differing(a, a) == ([], []) and fp.likeness(a, a) == 1.0
    assert 0 < fp.likeness(a, b) < 1


def test_different_texts_have_different_prints():
    texts = ["", "\n", "\n\n", " ", "a", "a\n", "\na", "a\n\nb", "a\nb", "a\n\n\nb", "ab", "a\n \nb"]
    assert len({fp.fingerprint(t) for t in texts}) == len(texts)
    assert all("\n".join(p for s in fp.sections(t) for p in s) == t for t in texts)


def test_rows_equal_brute_force(spark):
    rng = random.Random(4)
    words = [f"w{i}é" for i in range(9000)]
    texts = ["", None, "x", "abc"] + [" ".join(rng.choice(words) + rng.choice(["", "", ".\n", "\n\n"]) for _ in range(rng.randrange(1, 200))) for _ in range(120)] + ["long " * 30_000]
    rows = [(i * 3, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 1), (6, "x", 1), (6, "y", 1)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars int").repartition(5)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.edited_sha256, r.n_chars, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) for r in fp.fingerprint_edits(docs).collect())
    order = sorted(((-1 if i is None else i), (t or "").encode()) for i, t, _ in rows)
    want = []
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = t.decode(), u.decode()
        n = len(t) // 4
        e = t[: len(t) - n] + u[:n]
        a, b = fp.fingerprint(t), fp.fingerprint(e)
        want.append((i, hashlib.sha256(e.encode()).hexdigest(), len(t), a, b, fp.likeness(a, b), fp.likeness(a, fp.fingerprint(u))))
    assert got == sorted(want)
    long = [g for g in got if g[2] > 400 and g[2] < 100_000]
    assert min(g[5] - g[6] for g in long) > 0.3, sorted((g[5], g[6]) for g in long)[:5]


def test_small_tables(spark):
    docs = spark.createDataFrame([(1, "alone here")], "doc_id long, text string")
    assert fp.fingerprint_edits(docs.where("false")).count() == 0
    (row,) = fp.fingerprint_edits(docs).collect()
    assert row.near_next == 1.0 and row.n_chars == 10
