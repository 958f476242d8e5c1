import hashlib
import math
import random
from collections import Counter
from functools import reduce

import pytest
import regex
from millwright.llm import boosting, catalog, pii
from pyspark.sql import functions as F

# the contract's patterns, as they are written there
CONTRACT = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def holds(kind, v):
    digits = regex.sub("[^0-9]", "", v)
    return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in v.split(".")), "card": lambda: 12 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()


def rules(text):
    return [(m.start(), k, m.end()) for k, kind in enumerate(pii.KINDS) for m in regex.finditer(CONTRACT[kind], text) if holds(kind, m.group())]


def context(text, pattern):
    """Matches with what stands between them and their neighbours."""
    found = list(regex.finditer(pattern, text))
    ends = [0, *[m.end() for m in found]]
    starts = [*[m.start() for m in found[1:]], len(text)]
    return [(m, text[a : m.start()][-24:], text[m.end() : b][:8]) for m, a, b in zip(found, ends, starts)]


def described(kind, v, left, right):
    if kind == "email":
        v = regex.sub(pii._DOT, ".", regex.sub(r"\x20at\x20", "@", regex.sub(pii._AT, "@", v)))
    elif kind == "ip":
        v = regex.sub(r"[\[\]()]", "", v)
    else:
        v = regex.sub("[._/]", "-", v.replace("+", ""))
    runs = regex.findall("[0-9]+", v)

    def side(c):
        return 1 if regex.match("[A-Za-z]", c) else 2 if regex.match("[0-9]", c) else 3 if c and c in "\"'=" else 4 if regex.match(r"\S", c) else 0

    cues = {k: bool(regex.search(pii.CUES[k], left)) for k in pii.KINDS}
    return (
        min(24, len(regex.sub("[^0-9]", "", v))), min(24, len(regex.sub("[^A-Za-z]", "", v))), min(8, len(regex.sub("[A-Za-z0-9@.]", "", v))), sum(x in v for x in " -("),
        min(8, len(runs)), max([min(24, len(x)) for x in runs], default=0), min(24, len(runs[0])) if runs else 0, min(24, len(runs[-1])) if runs else 0, min(8, v.count(".") + 1),
        side(left[-1:]), side(right[:1]), int(bool(regex.search("[=:]\\s*[\"']?$", left))), int(cues[kind]), int(any(cues[k] for k in pii.KINDS if k != kind)),
    )


def candidates(text):
    base = rules(text)
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m, left, right in context(text, pii.WIDE[kind]):
            if not any(s < m.end() and e > m.start() for s, _, e in base):
                out.append((m.start(), k, m.end(), described(kind, m.group(), left, right)))
    return out


def walk(node, features):
    while node.split:
        node = node.below[features[node.split[0]] > node.split[1]]
    return node.value


def plain_spans(text, model):
    more = []
    for s, k, e, features in candidates(text):
        if k in model.thresholds:
            over = reduce(float.__add__, [walk(t, features) for t in model.forests[k].trees], model.forests[k].prior) - model.thresholds[k]
            if over >= 0:
                more.append((s, k, e, over))
    kept = []
    for x in sorted(more):
        if kept and kept[-1][2] > x[0]:
            if x[3] > kept[-1][3]:
                kept[-1] = x
        else:
            kept.append(x)
    return sorted([(*b, True) for b in rules(text)] + [(*x[:3], False) for x in kept])


def number(rng, shape):
    return "".join(str(rng.randrange(10)) if c == "9" else c for c in shape)


def card(rng):
    head = number(rng, "999999999999999")
    return next(head + d for d in "0123456789" if luhn(head + d))


def corpus(n, seed):
    """Texts with spans of the rules, the same in other spellings, and look-alikes in other contexts."""
    rng = random.Random(seed)
    made = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(1, 4)):
            parts.append(rng.choice([
                lambda: f"call +1 ({number(rng, '999')}) 555-{number(rng, '9999')} now", lambda: f"mail me: u{i}@host{i % 7}.example.com.", lambda: f"card {card(rng)} ok",
                lambda: f"host {rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)} up", lambda: f"order no {number(rng, '99999999')} sent",
                lambda: f"version {number(rng, '9.99.9')} and 1.2.3.999 x", lambda: f"meet@{'noon' if i % 2 else 'ten'} today", lambda: f"token = \"{number(rng, 'a999f9999999c99')}\"", lambda: "just words here, ümläut 🙂 é",
            ])())
        made.append(" | ".join(parts))
    return made


ODD = [
    None, "", "@", "a@b", "a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "001.002.003.004 256.1.1.1 1.1.1.0300", "4111 1111 1111 1111@x.com", "+1 ((((((((", "+1 2", "+" + "1 " * 12 + "x", "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5",
    "a@b.c" * 5, "🙂é x@y.zz 🙂 10.0.0.1é+49 (30) 1234-567", "user [at] host [dot] example [dot] com", "Bob AT site DOT org", "look at that dot", "joe at site dot org end", "10[.]0[.]0[.]1", "(212) 555-1234 and 00 49 30 123456", "4111-1111-1111-1111 4111.1111.1111.1111 4111111111111112", "\n@\n+1\n",
]


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(corpus(1500, 1))], "doc_id long, text string")
    return pii.learn(docs, sample=5000, trees=6)


def test_spans_equal_brute_force(spark, model):
    assert model.thresholds and all(model.forests[k].trees for k in model.thresholds)
    texts = ODD + corpus(300, 2) + [t.replace("@", " [at] ").replace(".example.", " [dot] example.").replace("+1 ", "1 ") for t in corpus(200, 3)]
    rows = [(i, t, "x", i) for i, t in enumerate(texts)] + [(None, "c@d.ef", None, 0), (5, "c@d.ef", "x", 1), (5, "c@d.ef", "x", 1)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string, spans string, _x int").repartition(3), model)
    assert found.columns == ["doc_id", "text", "_x", "spans"]
    added = 0
    for r in found.collect():
        want = plain_spans(r.text or "", model)
        assert [(s.start, pii.KINDS.index(s.kind), s.end, s.base) for s in r.spans] == want, r.text
        added += sum(not x[3] for x in want)
    assert added > 20
    for r in pii.digests(found).collect():
        text = next(t for i, t, *_ in rows if i == r.doc_id) if r.doc_id != 5 else None
        if text:
            base = [x for x in plain_spans(text, model) if x[3]]
            assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
            assert r.base_sha256 == hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e, _ in base).encode()).hexdigest()


def test_long_texts(spark, model):
    runs = ["7" * 200_000, "1 2" * 60_000, "a" * 300_000 + "@", "+1" + "(" * 200_000]  # nothing to find, and quadratic for a backtracking matcher
    many = ["1.2.3.4 " * 3_000 + "ü", "x@y.zz," * 2_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(runs + many)], "doc_id long, text string").repartition(6)
    for r in pii.find(docs, model).collect():
        assert [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.spans if s.base] == (sorted(rules(r.text)) if r.text in many else [])


def test_empty_tables(spark, model):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.digests(pii.find(none, model)).count() == 0
    assert pii.learn(none).thresholds == {}
    assert pii.digests(pii.find(spark.createDataFrame([(1, "a@b.cc")], "doc_id long, text string"), pii.learn(none))).first().spans == "email:0:6"


def test_all_documents_teach_and_set_thresholds(spark, monkeypatch):
    texts = [t for i in range(6_000) for t in (f"mail u{i}@host.org now", f"host 1.2.3.{i} up")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    read, told, make, low = [], [], pii.vectors, boosting.threshold
    monkeypatch.setattr(pii, "vectors", lambda d, text: read.append(d.count()) or make(d, text))
    monkeypatch.setattr(boosting, "threshold", lambda d, *rest: told.append((d.agg(F.sum("n")).first()[0], d.where("_m is null").count())) or low(d, *rest))
    model = pii.learn(docs, trees=2)
    assert read == [12_000]  # and no 10,000 of them
    assert told == [(6_000, 0)]  # every address, not a part; e-mails have one label only
    assert set(model.forests) == {pii.KINDS.index("ip")}


def test_redacted(spark, model):
    docs = spark.createDataFrame([(1, "é x@y.zz, 10.0.0.1!"), (2, None), (3, "1.2.3.4@h.com")], "doc_id long, text string")
    got = {r.doc_id: r.t for r in pii.find(docs, model).select("doc_id", pii.redacted().alias("t")).collect()}
    assert got == {1: "é [email], [ip]!", 2: "", 3: "[email]"}


def test_trees_equal_plain_boosting(spark):
    rng = random.Random(7)
    rows = [(g, rng.randrange(4), rng.randrange(3), rng.randrange(2)) for g in (0, 1, 2) for _ in range(120)]
    rows = [(g, a, b, c, int(g < 2 and rng.random() < (0.9 if (a > 1) == (b > g) else 0.2))) for g, a, b, c in rows]
    counted = Counter(r[:4] for r in rows)
    ones = Counter(r[:4] for r in rows if r[4])
    vectors = spark.createDataFrame([(*k, n, ones[k]) for k, n in counted.items()], "g int, a int, b int, c int, n long, y long")
    got = boosting.fit(vectors, "g", ["a", "b", "c"], trees=3, depth=2)
    assert not got[2].trees  # one label only
    for g in (0, 1):
        own = [r for r in rows if r[0] == g]
        margin = [math.log((sum(r[4] for r in own) + 0.5) / (sum(1 - r[4] for r in own) + 0.5))] * len(own)
        assert got[g].prior == pytest.approx(margin[0])
        for tree in got[g].trees:
            p = [1 / (1 + math.exp(-m)) for m in margin]
            grad, hess = [q - r[4] for q, r in zip(p, own)], [q * (1 - q) for q in p]

            def grow(node, inside, depth):
                total = lambda idx: (sum(grad[i] for i in idx), sum(hess[i] for i in idx))
                score = lambda s: s[0] ** 2 / (s[1] + 1)
                if depth == 2 or not node.split:
                    gs, hs = total(inside)
                    assert node.value == pytest.approx(-0.3 * gs / (hs + 1))
                    return
                gains = {}
                for f in range(3):
                    for v in range(3):
                        low, high = [i for i in inside if own[i][1 + f] <= v], [i for i in inside if own[i][1 + f] > v]
                        if low and high and min(total(low)[1], total(high)[1]) >= 1:
                            gains[f, v] = score(total(low)) + score(total(high)) - score(total(inside))
                assert gains[node.split] == pytest.approx(max(gains.values()))
                f, v = node.split
                grow(node.below[0], [i for i in inside if own[i][1 + f] <= v], depth + 1)
                grow(node.below[1], [i for i in inside if own[i][1 + f] > v], depth + 1)

            grow(tree, list(range(len(own))), 0)
            margin = [m + walk(tree, r[1:4]) for m, r in zip(margin, own)]


def test_thresholds(spark):
    rows = [("a", 3.0, 60, 60), ("a", 2.0, 40, 39), ("a", 1.0, 20, 0), ("b", 1.0, 5, 5)]
    got = boosting.threshold(spark.createDataFrame(rows, "g string, s double, n long, y long"), "g", "s", 0.9)
    assert got == {"a": 2.0}  # five rows of b prove too little


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = catalog.queries()["op11_pii"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        base = sorted(rules(texts[r.doc_id]))
        written = [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(",")) | {""}
