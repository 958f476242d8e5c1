import hashlib
import random
import re

import pytest
from millwright.llm import fill_middle as fm

PATTERN = {"line": r"[^\n]*\n|[^\n]+", "word": r"\A\s+|\S+\s*", "char": r"(?s)."}


def plainly(doc_id, text, unit="line", rate=100, spm=50):
    """Cut by a regular expression and string slices."""
    text = text or ""
    units = re.findall(PATTERN[unit], text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in fm.MARKS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


RNG = random.Random(3)
TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "  leading\nü🙂\r\nß\n", "has <P> inside\nb\n", "almost <P or <<S\n>\n", "́́\n​"] + ["".join(RNG.choice("ab ü🙂\n\n<P>SM") for _ in range(RNG.randrange(80))) for _ in range(150)]


@pytest.mark.parametrize("unit", ["line", "word", "char"])
def test_equals_slices(spark, unit):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(None, "a\nb\nc\n", "x", 0), (5, "a\nb", None, 0), (5, "a\nb", None, 0), (900, "many\n" * 300_000 + "é", "long", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, keep int").repartition(3)
    made = fm.fill_in_middle(docs, unit=unit, rate=90, spm=30)
    assert made.columns == ["doc_id", "keep", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = [(r[0], r[2:7], r["back"]) for r in made.withColumn("back", fm.restored()).collect()]
    want = [(i, plainly(i, t, unit, 90, 30), t or "") for i, t, _, _ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {w[1][1] for w in want} == {"plain", "psm", "spm"}


def test_empty_table_and_bad_marks(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert fm.digests(fm.fill_in_middle(docs)).count() == 0
    with pytest.raises(ValueError):
        fm.fill_in_middle(docs, marks=("<P>", "<S>", "><S"))


def test_selected_bits():
    for _ in range(200):
        width = RNG.randrange(1, 300)
        bits = RNG.getrandbits(width)
        places = [i for i in range(width) if bits >> i & 1]
        assert [fm.select(bits, width, k) for k in range(len(places) + 1)] == [*places, width]
