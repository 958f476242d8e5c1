"""Quality rules under weak supervision.

Each rule looks at a few facts of a whole text and votes good, bad or abstains. How far each rule can
be trusted isn't set by hand: expectation-maximisation over all documents fits, for a two-class
mixture, how often a rule blames good and bad documents when it votes, and the share of good ones.
The posterior probability of being good replaces passing every rule: a document that one rule blames
is kept if that rule blames good ones too, or if the others outweigh it.

The documents reach the fit only as counts of vote patterns: at most 3 ** len(RULES) rows whatever
the size of the corpus, so the fit is exact over all documents and runs on the driver.
"""

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.batches import apart, map_texts, together
from millwright.store import cut

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: further facts that the rules look at
MORE = ["n_lines", "n_upper", "n_letters", "n_shouts", "n_stutter", "n_bars"]
GOOD, BAD, ABSTAIN = 1, -1, 0


def facts(text: str) -> tuple[int, ...]:
    """The facts ``COUNTS`` and ``MORE`` of a whole text; all 0 for an empty one."""
    words = WORDS.findall(text)
    n = len(words)
    repeat = 0
    if n >= 4:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            seen = Counter(windows)
            last = -1
            for i, w in enumerate(windows):
                if seen[w] > 1:
                    repeat += min(3, i + 2 - last)
                    last = i + 2
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    joined = "".join(words)
    upper = sum(map(joined.count, _UPPER)) if joined.isascii() else sum(map(str.isupper, joined))
    letters = sum(map(str.isalpha, joined)) if not joined.isalpha() else len(joined)
    stutter = sum(map(str.__eq__, words, words[1:]))
    return (
        n, len(joined), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeat,
        len(lines), upper, letters, joined.count("!"), stutter, joined.count("|"),
    )


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def with_facts(docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    def make():
        return lambda texts: dict(zip([*COUNTS, *MORE], zip(*map(facts, texts), strict=True), strict=True)) if texts else {k: [] for k in [*COUNTS, *MORE]}

    return map_texts(docs, text, make, [T.StructField(k, T.LongType()) for k in [*COUNTS, *MORE]], keep_text)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules(fact=F.col) -> dict[str, Column]:
    """Each rule's vote as an expression over facts. Short or wordless texts make rules abstain, and so
    does the ground between clearly good and clearly bad. Every kind of fault is seen by two rules or
    more, so that the fit has agreement to learn from."""
    n, chars, lines, letters = fact("n_words"), fact("word_chars"), fact("n_lines"), fact("n_letters")
    some = n >= 1
    return {
        "symbols": _vote(some & (fact("n_symbols") * 50 < n), some & (fact("n_symbols") * 5 > n)),
        "symbol_share": _vote(some & (fact("n_symbols") * 200 < chars), some & (fact("n_symbols") * 20 > chars)),
        "bars": _vote(some & (fact("n_bars") * 50 < n), some & (fact("n_bars") * 10 > n)),
        "shouting": _vote((letters >= 10) & (fact("n_upper") * 10 < letters), (letters >= 10) & (fact("n_upper") * 3 > letters)),
        "exclaiming": _vote(some & (fact("n_shouts") * 50 < n), some & (fact("n_shouts") * 10 > n)),
        "letters": _vote(some & (letters * 100 >= chars * 90), some & (letters * 100 < chars * 80)),
        "stutter": _vote((n >= 10) & (fact("n_stutter") * 30 < n), (n >= 5) & (fact("n_stutter") * 10 > n)),
        "repeats": _vote((n >= 20) & (fact("n_repeat_words") * 10 < n), (n >= 10) & (fact("n_repeat_words") * 5 > n)),
        "duplicate_lines": _vote((lines >= 3) & (fact("n_dup_lines") * 10 < lines), (lines >= 3) & (fact("n_dup_lines") * 5 > lines)),
        "word_length": _vote((n >= 10) & (chars * 10).between(n * 40, n * 65), (n >= 10) & ~(chars * 10).between(n * 35, n * 70)),
    }


#: (votes, of them bad) that each rule is taken to have cast on good and on bad documents beforehand: hardly any
#: weight, but a corpus without bad documents isn't split on a whim
BEFORE = {"good": (12.0, 1.2), "bad": (12.0, 7.0)}


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500) -> tuple[float, np.ndarray]:
    """Share of good documents, and for (class good/bad, rule) the chance that a vote cast is for bad.

    Plain expectation-maximisation of a two-class mixture in which rules vote independently of each
    other and abstaining says nothing. It starts from each document's share of votes for good and runs
    until no posterior moves; the class that draws fewer bad votes is the good one.
    """
    cast, bad = patterns != ABSTAIN, patterns == BAD
    post = ((patterns == GOOD).sum(1) + 1) / (cast.sum(1) + 2)
    votes, blamed = (np.array([[BEFORE[c][k]] for c in ("good", "bad")]) for k in (0, 1))
    for _ in range(rounds):
        weight = np.stack([post, 1 - post]) * counts
        share = float((weight[0].sum() + 1) / (counts.sum() + 2))
        chance = (weight @ bad + blamed) / (weight @ cast + votes)
        after = posterior(patterns, share, chance)
        moved, post = np.abs(after - post).max(initial=0), after
        if moved < 1e-9:
            break
    return (share, chance) if chance[0].mean() <= chance[1].mean() else (1 - share, chance[::-1])


def evidence(chance: np.ndarray) -> np.ndarray:
    """Log odds for good of (rule, vote + 1); 0 for abstaining."""
    return np.stack([np.log(chance[0] / chance[1]), np.zeros(chance.shape[1]), np.log((1 - chance[0]) / (1 - chance[1]))], 1)


def posterior(patterns: np.ndarray, share: float, chance: np.ndarray) -> np.ndarray:
    odds = evidence(chance)
    z = np.log(share / (1 - share)) + odds[np.arange(patterns.shape[1]), patterns + 1].sum(1)
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def judge(with_counts: DataFrame, name: str = "p_quality", votes: dict[str, Column] | None = None) -> DataFrame:
    """Adds the posterior probability that a row is good; ``with_counts`` holds the facts."""
    votes = votes or rules()
    powers = [3**i for i in range(len(votes))]
    code = sum(((v + 1) * p for v, p in zip(votes.values(), powers, strict=True)), F.lit(0))
    seen = with_counts.groupBy(code.alias("code")).count().toPandas()  # at most 3 ** rules rows
    codes = seen["code"].to_numpy(np.int64)
    patterns = (codes[:, None] // np.array(powers)) % 3 - 1
    share, chance = fit(patterns, seen["count"].to_numpy(float))
    z = F.lit(float(np.log(share / (1 - share))))
    for v, odds in zip(votes.values(), evidence(chance), strict=True):
        z = z + F.when(v == BAD, float(odds[0])).when(v == GOOD, float(odds[2])).otherwise(0.0)
    return with_counts.withColumn(name, 1 / (1 + F.exp(-z)))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def rule_quality(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The other columns of ``docs``, the facts, ``base_failed``, ``p_quality`` and ``kept``.

    Null texts count as empty: they have no words and fail. Repeated rows are judged alike; an empty
    table gives an empty result. Columns of ``docs`` that are called like a fact are replaced.
    """
    made = [*COUNTS, *MORE, "base_failed", "p_quality", "kept"]
    table = cut(with_facts(docs.drop(*made), text), "quality-facts")
    return judge(table).withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.col("p_quality") >= threshold))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns and no others."""
    table = cut(with_facts(apart(docs, text), "_text", True), "quality-kept")
    return judge(table).where(~base_failed() & (F.col("p_quality") >= threshold)).select(*together(docs.columns, text))
