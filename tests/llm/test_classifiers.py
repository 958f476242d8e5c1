import random
import zlib

import numpy as np
import pytest
from millwright.llm import quality_classifier as q
from millwright.llm import quality_rules as rules
from millwright.llm import toxicity as tox

CLEAN = "the river runs past the old mill and the miller counts his sacks of flour every morning".split()


def corpus(n=400):
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(CLEAN, k=rng.randrange(20, 80))
        good, bad = rng.random() < 0.7, rng.random() < 0.3
        if bad:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["idiot", "SCUM", "zorgling", "zorgfle"]))
        text = " ".join(words) if good else " ".join(w + "$$$" for w in words)
        docs.append((i, text, "x", 0.5))
        labels.append((i, int(good), int(bad)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    docs += [(None, None, "y", None), (9000, "", "y", 1.0), (9001, "word " * 50_000, "y", 1.0), (0, docs[0][1], "x", 0.5)]
    labels += [(None, 1, 1), (9000, None, None), (0, labels[0][1], labels[0][2])]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


@pytest.mark.parametrize(("run", "label", "parts", "part", "cut"), [(q.classify, "quality", 4, 2, 0.7), (tox.classify, "toxic", 5, 0, 0.5)])
def test_held_out_accuracy(spark, tables, run, label, parts, part, cut):
    docs, labels = tables
    rows = run(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r[label] for r in labels.collect() if r[label] is not None and r.doc_id is not None}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert held and all(zlib.crc32(str(r.doc_id).encode()) % parts == part for r in held)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= cut) for r in rows)
    assert len({r.score for r in rows if r.doc_id == 0}) == 1
    assert not any(r.held_out for r in rows if r.doc_id is None)


@pytest.mark.parametrize("run", [q.classify, tox.classify])
def test_empty_tables(tables, run):
    docs, labels = tables
    assert run(docs.where("false"), labels).count() == 0
    assert run(docs.limit(5), labels.where("false")).count() == 5


def score(model, text):
    return float(q.scores(model, q._Words(model.scores), [text])[0])


def test_long_words_count_whole(monkeypatch):
    words = ["x" * 200, "ab" * 150, "日本語テキスト" * 60, "z" * 201 + "\ud800"]
    buckets = q.BUCKETS + q.PAIRS
    model = q.Model(np.random.default_rng(1).normal(size=buckets).astype(np.float32), 0.1)
    for size in (q.PIECE, 50):
        monkeypatch.setattr(q, "PIECE", size)
        for w in words:
            want = q.features(w)
            assert sorted(want) == sorted(np.concatenate(list(q.long_features(w))).tolist())
            ids, shares = q.bag(f"{w} b {w}")
            pairs = q.pair_buckets(np.array([q.pair_hashes(x) for x in (w, "b", w)])).tolist()
            assert len(pairs) == 8 and all(q.BUCKETS <= p < buckets for p in pairs)
            whole = 2 * want + q.features("b") + pairs
            every = np.bincount(whole, minlength=buckets)
            assert ids.tolist() == np.flatnonzero(every).tolist() and np.allclose(shares, every[ids] / every.sum(), rtol=1e-5)
            z = model.scores[whole].mean(dtype=float) + 0.1
            assert abs(score(model, f"{w} b {w}") - 1 / (1 + np.exp(-z))) < 1e-6
    assert score(model, "x" * 300 + "abc") != score(model, "x" * 300 + "xyz")
    assert score(model, "a b") != score(model, "b a")
    assert q.bag("")[0].size == q.bag(" \n")[0].size == 0
    assert abs(score(model, " \n") - 1 / (1 + np.exp(-0.1))) < 1e-9


def test_words_forgotten_give_the_same(monkeypatch):
    model = q.Model(np.random.default_rng(1).normal(size=q.BUCKETS + q.PAIRS).astype(np.float32), 0.0)
    texts = [" ".join(random.Random(i).choices(CLEAN, k=30)) for i in range(20)]
    want, known = [score(model, t) for t in texts], q._Words(model.scores)
    monkeypatch.setattr(q, "MAX_WORDS", 5)
    assert np.allclose([q.scores(model, known, [t])[0] for t in texts], want)


def found(text):
    return dict(tox.marks(text, tox.Lexicon({}), tox.grammar(), tox.backward()))


def test_grammar_matches_clauses():
    assert found("He is an idiot.") == found("You are such a total moron") == found("you're scum") == {"ic ": 1.0}
    assert found("you idiot!") == found("idiots like you") == {"ia ": 1.0}
    assert found("It is not so. What trash") == found("the idiot of the village") == {"i  ": 1.0}
    assert found("She is not an idiot.") == {"icn": 1.0}
    assert found("They said you are scum") == found("you are scum, he wrote") == found('"you are scum"') == {"icr": 1.0}
    assert found("I will kill you") == found("Ich werde dich töten") == found("Je vais te tuer") == found("A ti te voy a matar") == {"tc ": 1.0}
    assert found("Je te tuerai") == found("kill yourself") == found("I'll hurt them") == found("I’ll hurt them") == {"tc ": 1.0}
    assert found("I will not kill you") == {"tcn": 1.0}
    assert found("I will kill you, he said") == found("«I will kill you»") == {"tcr": 1.0}
    assert found("She beat them at chess") == {"ta ": 1.0}
    assert found("She beat the eggs. You look") == found("The frost will kill it") == {"t  ": 1.0}
    assert found("") == found("a calm day") == {}


def test_clauses_score_above_words(spark, tables):
    texts = ["I will kill you", "Ich werde dich töten", "Je vais te tuer", "Te voy a matar", "She beat the eggs", "I will not kill you", "I will kill you, he said", "you are an idiot", "you idiot", "an idiot", "you are not an idiot", '"you are an idiot"', "kill", ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for labels in (tables[1], tables[1].where("false")):
        model = tox.fit(tables[0], labels)
        got = [r.score for r in tox.with_score(rows, model).orderBy("doc_id").collect()]
        assert [x >= 0.5 for x in got[:7]] == [True] * 4 + [False] * 3
        full, address, word, negated, quoted, verb, nothing = got[7:]
        assert full > address > word > nothing and full > address >= 0.5
        assert full > negated and full > quoted and abs(verb - nothing) < 1e-12
    assert word < 0.5 and negated < 0.5 and quoted < 0.5  # by the prior weights


def test_weights_keep_their_order():
    rng = np.random.default_rng(3)
    for _ in range(50):
        w = dict(zip(tox.MARKS, tox.ordered(rng.random(len(tox.MARKS)) * 6), strict=True))
        for k in "it":
            assert w[k + "  "] < w[k + "a "] < w[k + "c "]
            assert all(w[k + f + s] <= w[k + f + " "] and w[k + f + s] >= 0 for f in " ac" for s in "nr")
        assert w["t  "] == 0


def test_keep_good_returns_the_columns(tables):
    docs, labels = tables
    kept = q.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def brute(text):
    words = rules.WORDS.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if rules.WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules_equal_brute_force(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t", "a b c", "a b c a b c", "x\nx\ny\n\nx", "# * | <a> b c"] + ["".join(rng.choice(["a ", "b ", "c\n", "#", "é", "| ", " "]) for _ in range(rng.randrange(200))) for _ in range(150)]
    texts += [" ".join(rng.choices(CLEAN, k=120)) for _ in range(200)] + [" ".join(w + "$$$" for w in rng.choices(CLEAN, k=120)) for _ in range(40)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in rules.rule_quality(docs).collect()}
    for i, t in enumerate(texts):
        r, (n, chars, symbols, dup, rep) = got[i], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep)
        assert r.base_failed == (n < 50 or 100 * rep > 50 * n) and (not r.base_failed or not r.kept)
    assert all(got[i].kept or got[i].base_failed for i in range(len(texts) - 240, len(texts) - 40))
    assert not any(got[i].kept for i in range(len(texts) - 40, len(texts)))
    assert rules.rule_quality(docs.where("false")).count() == 0
    assert rules.keep_good(docs).columns == docs.columns


def plain_em(rows, rounds):
    """The mixture fitted document by document, with plain loops and no log odds."""
    k = len(rows[0])
    good = [(sum(v == 1 for v in r) + 1) / (sum(v != 0 for v in r) + 2) for r in rows]
    for _ in range(rounds):
        share = (sum(good) + 1) / (len(rows) + 2)
        blame = []
        for weights, (votes, blamed) in ((good, rules.BEFORE["good"]), ([1 - g for g in good], rules.BEFORE["bad"])):
            blame.append([(blamed + sum(w for w, r in zip(weights, rows) if r[j] == -1)) / (votes + sum(w for w, r in zip(weights, rows) if r[j] != 0)) for j in range(k)])
        good = []
        for r in rows:
            p, q_ = share, 1 - share
            for j, v in enumerate(r):
                if v:
                    p *= blame[0][j] if v == -1 else 1 - blame[0][j]
                    q_ *= blame[1][j] if v == -1 else 1 - blame[1][j]
            good.append(p / (p + q_))
    return share, blame, good


def votes_of(n, seed=2):
    """Votes of six rules, two of them on one kind of fault each, one that blames at random."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        fault = rng.choice("abc") if rng.random() < 0.2 else ""
        row = [-1 if (fault == kind) != (rng.random() < 0.02) else 1 for kind in "aabbc"] + [rng.choice((-1, 1))]
        rows.append([0 if rng.random() < 0.1 else v for v in row])
    return np.array(rows)


def test_fit_equals_a_plain_em():
    rows = votes_of(300)
    patterns, counts = np.unique(rows, axis=0, return_counts=True)
    share, chance = rules.fit(patterns, counts.astype(float))
    want_share, want_chance, want = plain_em(rows.tolist(), 400)
    assert abs(share - want_share) < 1e-5 and np.allclose(chance, want_chance, atol=1e-5)
    assert np.allclose(rules.posterior(rows, share, chance), want, atol=1e-4)


def test_verdict_is_not_all_must_pass(spark):
    rng = random.Random(4)
    clean = [" ".join(rng.choices(CLEAN, k=60)) for _ in range(300)]
    fine = [" ".join(rng.choices(CLEAN, k=30)) + "\na line\na line\n" + " ".join(rng.choices(CLEAN, k=30)) for _ in range(30)]
    junk = [" ".join(w + "$$$" for w in rng.choices(CLEAN, k=60)) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(clean + fine + junk)), "doc_id long, text string")
    table = rules.with_facts(docs)
    blamed = {r.doc_id for r in table.select("doc_id", *(v.alias(k) for k, v in rules.rules().items())).collect() if -1 in r[1:]}
    got = {r.doc_id: r.kept for r in rules.rule_quality(docs).collect()}
    assert set(range(300, 330)) <= blamed
    assert all(got[i] for i in range(330)) and not any(got[i] for i in range(330, 370))


def test_a_corpus_without_bad_documents_is_kept(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, " ".join(rng.choices(CLEAN, k=80))) for i in range(200)], "doc_id long, text string")
    assert all(r.kept for r in rules.rule_quality(docs).collect())


def test_rules_stage_on_odd_rows(spark):
    text = " ".join(random.Random(7).choices(CLEAN, k=80))
    rows = [(None, text, 1), (1, None, 1), (2, "", 2), (3, text, None), (3, text, None), (4, text + " word " * 100_000, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    assert sorted((str(r.doc_id), r.n_words) for r in rules.keep_good(docs).collect()) == [("3", None), ("3", None), ("None", 1)]
    assert rules.keep_good(docs.where("false")).count() == 0
