import hashlib
import pickle
import random
from collections import Counter

import numpy as np
from millwright.llm import bitmaps, repeats

SPAN = repeats.SPAN


def brute(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + SPAN] for b in data for i in range(len(b) - SPAN + 1))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - SPAN + 1):
            if seen[b[i : i + SPAN]] > 1:
                gone[i : i + SPAN] = b"\1" * SPAN
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéfghij") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(200) for _ in range(4)]
    texts = [None, "", "x" * 399, "x" * 400, "y" * 401, "ab" * 500, prose(500), "é" * 300]
    for _ in range(40):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts.append(prose(rng.randrange(60)))
            if rng.random() < 0.6:
                p = rng.choice(shared)
                a = rng.randrange(0, 500)
                parts.append(p[a : a + rng.choice([300, 380, 395, 400, 405, 420, 600, 900])])
        texts.append(" ".join(parts))
    base = prose(900)
    for _ in range(12):  # near copies
        i = rng.randrange(len(base))
        texts.append(base[:i] + word() + base[i + 5 :])
    return texts + [texts[-1], texts[-1], texts[6]]


def test_rows_equal_brute_force(spark):
    texts = corpus()
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, texts[7], 1), (3, texts[10], 1), (3, texts[10], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_spans int").repartition(3)
    want = Counter((r[0], *b) for r, b in zip(rows, brute([r[1] for r in rows])))
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removal_digests(docs).collect())
    assert got == want
    assert repeats.removal_digests(docs.where("false")).count() == 0


def test_false_positives_and_chunks_change_nothing(spark, monkeypatch):
    import numpy as np

    texts = corpus()[8:30]
    whole, cut = repeats.Open(), repeats.Open()
    full = np.full(bitmaps.WORDS, np.iinfo(np.uint64).max, np.uint64)
    cut.grams = cut.contexts = cut.commons = cut.edges = full
    for t in texts:
        data = np.frombuffer(t.encode(), np.uint8)
        for level in repeats.COLUMNS:
            a, b = repeats.scan(data, level, whole), repeats.scan(data, level, cut)
            assert all((a[k] == b[k]).all() for k in a)
        monkeypatch.setattr(repeats, "CHUNK", 700)
        parts = repeats.scan(data, "windows", whole)
        monkeypatch.undo()
        every = repeats.scan(data, "windows", whole)
        assert {*zip(every["start"].tolist(), every["id"].tolist())} == {*zip(parts["start"].tolist(), parts["id"].tolist())} if every else not parts


def test_chunks_give_the_levels_of_the_whole_text(monkeypatch):
    import numpy as np

    rng = random.Random(12)
    for n in (400, 700, 1099, 1100, 1101, 1436, 6000):
        data = np.frombuffer(bytes(rng.randrange(97, 123) for _ in range(n)), np.uint8)
        for level in repeats.COLUMNS:
            whole = repeats.scan(data, level, repeats.Open())
            monkeypatch.setattr(repeats, "CHUNK", 700)
            parts = repeats.scan(data, level, repeats.Open())
            monkeypatch.undo()
            assert all(whole[k].tolist() == parts[k].tolist() for k in whole)


def test_chunked_texts_without_repeats_lose_nothing(spark, monkeypatch):
    from pyspark.cloudpickle import register_pickle_by_value, unregister_pickle_by_value

    rng = random.Random(13)
    prose = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    shared = prose(450)
    texts = [prose(6000), prose(3001), prose(900) + shared + prose(700), prose(250) + shared + prose(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(repeats, "CHUNK", 700)
    register_pickle_by_value(repeats)  # the workers get CHUNK as it is set here
    try:
        got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removal_digests(docs).orderBy("doc_id").collect()]
    finally:
        unregister_pickle_by_value(repeats)
    assert got == brute(texts) and got[0][1] == got[1][1] == 0


def test_stage_returns_the_columns(spark):
    shared = "".join(random.Random(9).choice("abcdefgh ") for _ in range(600))
    docs = spark.createDataFrame([(1, "one " + shared, "en", 604), (2, "two " + shared + " end", "en", 608), (3, None, None, 0)], "doc_id long, text string, lang string, n_chars long")
    got = repeats.remove_repeats(docs)
    assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
    assert {r.doc_id: (r.text, r.lang, r.n_chars) for r in got.collect()} == {1: ("one", "en", 3), 2: ("two end", "en", 7), 3: ("", None, 0)}


def test_later_rounds_pass_over_texts_without_repeated_anchors(spark, monkeypatch):
    import numpy as np

    rng = random.Random(14)
    prose = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    exact, shared, short = prose(SPAN), prose(SPAN), prose(390)  # a text of one window, a string inside texts, one too short
    texts = [exact, exact, prose(700) + shared + prose(50), shared + prose(900), short + prose(600), prose(600) + short, prose(3000), prose(2000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    levels, level = {}, repeats.level

    def spy(df, name, known):
        levels[name] = known
        return level(df, name, known)

    monkeypatch.setattr(repeats, "level", spy)
    got = [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removal_digests(docs).orderBy("doc_id").collect()]
    assert got == brute(texts)
    assert [g[1] for g in got] == [400, 400, 400, 400, 0, 0, 0, 0]
    only = repeats.Open()
    only.texts = levels["windows"].texts
    scanned = {r._id for r in level(repeats.keyed(docs), "windows", only).select("_id").distinct().collect()}
    assert {0, 1, 2, 3} <= scanned and not scanned & {6, 7}
    hashes = np.array([r._hash for r in repeats.keyed(docs).orderBy("_id").collect()]).view(np.uint64)
    assert {*np.flatnonzero(bitmaps.has(only.texts, hashes)).tolist()} == scanned


def test_what_is_open_travels_in_a_few_bytes():
    known = repeats.Open()
    known.grams, known.texts = np.zeros(bitmaps.WORDS, np.uint64), np.random.default_rng(2).integers(0, 1 << 63, bitmaps.WORDS, np.uint64)
    known.grams[5] = 3
    sent = pickle.dumps(known)
    assert len(sent) < 9 * bitmaps.WORDS
    again = pickle.loads(sent)
    assert (again.grams == known.grams).all() and (again.texts == known.texts).all() and again.commons is None
