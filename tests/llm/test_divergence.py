import random
import re
from collections import Counter, defaultdict

from millwright.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "lang string, source string, text string, term string, count int"


def plainly(rows, least=3, top=200):
    """Every (pair, term) one by one, with Python's integers."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text, *_ in rows:
        lang, source = lang or "", source or ""
        found = TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        groups[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        sources = [s for g, s in groups if g == lang]
        total = Counter()
        for s in sources:
            total.update({t: groups[lang, s][t] for t in kept})

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 1) // (n + len(kept)) for t in kept}

        p, q = shares(groups[lang, source]), shares(total)
        f = lambda a, b: (a - b) * (a - b) // b
        pair = [(s, sum(f(p[t], x[t]) for t in kept)) for s in sources if s != source for x in [shares(groups[lang, s])]]
        term = [(t, f(p[t], q[t])) for t in kept if groups[lang, source][t] and p[t] > q[t]]
        for part, items, most in (("pair", pair, None), ("term", term, top)):
            ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


def check(spark, rows, **kw):
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(5), **{a: b for a, b in kw.items() if a in ("least_docs", "top_terms")})
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == plainly(rows, kw.get("least_docs", 3), kw.get("top_terms", 200))


def test_equals_brute_force(spark):
    rng = random.Random(4)
    words = [f"{a}{b}" for a in "aäbcÄßзЗ" for b in ("", "x", "Yz", "é")]
    rows = []
    for _ in range(400):
        lang = rng.choice(["en", "de", None, ""])
        source = "hot" if rng.random() < 0.4 else rng.choice(["s1", "s2", "s3", None, "ß"])
        k = rng.randrange(40)
        rows.append((lang, source, " ".join(rng.choice(words[: 8 + 6 * len(source or "")]) for _ in range(k)), "t", 1))
    rows += [rows[0], rows[0], ("en", "silent", None, None, None), ("en", "digits", "12 34", None, None), ("lone", "one", "only here only here", None, None), ("rare", "a", "x", None, 0), ("rare", "b", "y", None, 0)]
    rows += [("en", "long", "word Other " * 200_000, None, None)]
    check(spark, rows, top_terms=5)


def test_small_task_tables(spark, monkeypatch):
    monkeypatch.setattr(divergence, "MOST_ENTRIES", 3)
    check(spark, [("l", f"s{i % 3}", f"a b{i % 2} c{i % 5} a", None, None) for i in range(40)], least_docs=2)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares_beyond_a_long(spark):
    row = spark.range(1).selectExpr("9000000000000000000L as c", "9100000000000000000L as n", "5L as v").select(divergence.share("c", "n", "v").alias("p")).first()
    assert row["p"] == 1 + 10**9 * (9 * 10**18 + 1) // (91 * 10**17 + 5)
