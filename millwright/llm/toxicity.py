"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer reads a word and writes its class: insult, verb of harm, target, subject, copula,
modal, negation, reported speech, quotation mark, other, or the end of a clause. Rewriting transducers
are composed over the classes, one clause pattern each:

* predication: target or subject, copula, then an insult ("you are a ...")
* address: an insult beside a target ("you ...", "... like you")
* threat: a modal or the start of the clause, then a verb of harm, and a target on either side of it
* negation, reported speech and quotation: what stands in their scope weighs less

Clauses are read backwards too, for what stands behind. Each insult or verb of harm ends up as one
matched clause pattern, and a document's score is a logistic function of the weights of its patterns.
A verb of harm without its clause weighs nothing. An insult without a clause is a pattern of its own,
the weakest: by the prior weights it stays below one half, and only labelled documents can raise it. In
every fit a fuller pattern weighs more than a barer one, and a negated or reported one less.

The insult lexicon is the one below plus word forms and stems that the labelled documents show, each
with its log odds. The weights of the patterns are fitted on the same labelled documents, drawn
towards the prior weights where those show little.
"""

import math
import re
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.batches import map_texts
from millwright.llm.labelled import held_out, sample

# fixed values: the words of the classes
INSULTS = "idiot idiots moron morons stupid loser losers scum trash worthless pathetic disgusting clown dumb imbecile".split()
HARMS = "kill hurt destroy punch stab shoot beat".split()
HARMS += "töten töte umbringen verletzen vernichten zerstören schlagen verprügeln erstechen erschießen".split()
HARMS += "tuer blesser détruire frapper poignarder abattre tabasser".split()
HARMS += "matar golpear herir destruir apuñalar disparar".split()
#: verbs of harm whose ending is the modal
FUTURES = "tuerai blesserai détruirai frapperai poignarderai tabasserai mataré matarte golpearé destruiré".split()
TARGETS = "you your u them him her yourself yourselves du ihr dich dir euch tu te vous toi ti usted".split()
#: an insult may be said of these; before a verb of harm they name who acts, not whom it is aimed at
SUBJECTS = "he she they this these those that sie eres ellos".split()
COPULAS = "are is were was am be being bist ist sind seid est êtes sont son".split()
#: target and copula in one word
ADDRESSES = "you're they're he's she's eres".split()
MODALS = "will shall gonna going want must should i'll we'll they'll he'll werde werden wirst will soll muss vais va allons voy vamos quiero".split()
NEGATIONS = "not no never isn't aren't wasn't don't doesn't won't nicht kein keine nie pas jamais nunca".split()
REPORTS = "said says say claimed claims wrote called calling quoted according sagte dit dijo".split()
QUOTES = list("\"“”„«»")
ENDS = list(".!?;:|\n")

OTHER, INSULT, HARM, TARGET, SUBJECT, COPULA, ADDRESS, MODAL, NEGATION, REPORT, QUOTE, END = "oitascdmnrq."
CLASSES = (OTHER, INSULT, HARM, TARGET, SUBJECT, COPULA, ADDRESS, MODAL, NEGATION, REPORT, QUOTE, END)
#: patterns: an insult or a verb of harm; alone, aimed, or in a full clause; plain, negated or reported
MARKS = [k + a + s for k, a, s in product("it", " ac", " nr")]
#: prior weights, in log odds
_FORMS = {"i ": 1.5, "ia": 3.7, "ic": 4.7, "t ": 0.0, "ta": 1.5, "tc": 4.2}
SCOPE_COST, STEP = 2.5, 0.5
PRIOR = {m: max(0.0, _FORMS[m[:2]] - (SCOPE_COST if m[2] != " " else 0.0)) for m in MARKS}
BIAS = -3.0
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:|\n\"“”„«»]")
STEM = range(3, 9)


class Transducer:
    """Deterministic: ``step(state, symbol)`` gives the next state and the symbol written."""

    def __init__(self, start, step):
        self.start, self.step, self.table = start, step, {}

    def then(self, other: "Transducer") -> "Transducer":
        """The composition: ``other`` reads what this one writes."""

        def step(state, symbol):
            mine, out = self.step(state[0], symbol)
            theirs, out = other.step(state[1], out)
            return (mine, theirs), out

        return Transducer((self.start, other.start), step)

    def run(self, symbols):
        """The symbols written; transitions are compiled when first taken."""
        state, table = self.start, self.table
        for s in symbols:
            made = table.get((state, s))
            if made is None:
                made = table[state, s] = self.step(state, s)
            state = made[0]
            yield made[1]


# Symbols of insults and verbs of harm carry their marks: kind, aim, link (copula or modal), scope.


def _marked(symbol: str, place: int, mark: str) -> str:
    full = symbol.ljust(4)
    return full if full[place] != " " else full[:place] + mark + full[place + 1 :]


def scope(trigger: str, mark: str, reach: int, place: int, kinds: tuple[str, ...] = (INSULT, HARM)) -> Transducer:
    """Puts ``mark`` at ``place`` of ``kinds`` within ``reach`` words after ``trigger``, in a clause."""

    def step(left, symbol):
        if symbol == END:
            return 0, symbol
        if symbol == trigger:
            return reach, symbol
        return max(0, left - 1), _marked(symbol, place, mark) if left and symbol[0] in kinds else symbol

    return Transducer(0, step)


def predication(gap: int = 3, reach: int = 5) -> Transducer:
    """Target or subject, then within ``gap`` words a copula, then within ``reach`` words an insult: link ``c``."""

    def step(state, symbol):
        who, linked = state
        if symbol == END:
            return (0, 0), symbol
        if symbol == ADDRESS:
            return (0, reach), symbol
        if symbol == COPULA and who:
            return (0, reach), symbol
        after = gap if symbol in (TARGET, SUBJECT) else max(0, who - 1), max(0, linked - 1)
        return after, _marked(_marked(symbol, 1, "a"), 2, "c") if linked and symbol[0] == INSULT else symbol

    return Transducer((0, 0), step)


def opening() -> Transducer:
    """A verb of harm that starts a clause is a demand: link ``m``."""

    def step(inside, symbol):
        if symbol in (END, QUOTE):
            return False, symbol
        return True, _marked(symbol, 2, "m") if not inside and symbol[0] == HARM else symbol

    return Transducer(False, step)


def quotation() -> Transducer:
    """What stands between two quotation marks of a clause is reported."""

    def step(open_, symbol):
        if symbol == END:
            return False, symbol
        if symbol == QUOTE:
            return not open_, symbol
        return open_, _marked(symbol, 3, "r") if open_ and symbol[0] in (INSULT, HARM) else symbol

    return Transducer(False, step)


def grammar() -> Transducer:
    aimed = scope(TARGET, "a", 2, 1, (INSULT,)).then(scope(TARGET, "a", 6, 1, (HARM,)))
    linked = predication().then(scope(MODAL, "m", 4, 2, (HARM,))).then(opening())
    return aimed.then(linked).then(scope(NEGATION, "n", 3, 3)).then(scope(REPORT, "r", 12, 3)).then(quotation())


def backward() -> Transducer:
    """What marks from behind; it reads the classes from the last to the first."""
    return scope(TARGET, "a", 3, 1, (INSULT,)).then(scope(TARGET, "a", 6, 1, (HARM,))).then(scope(REPORT, "r", 12, 3))


def pattern(symbol: str) -> str:
    """The clause pattern of a marked symbol: one of ``MARKS``."""
    kind, aim, link, what = symbol.ljust(4)
    form = aim if kind == HARM and link != "m" or link == " " else "c" if aim == "a" else " "
    return kind + form + what


class Lexicon(dict):
    """word -> (class, weight). Stems match the longest known start of a word."""

    def __init__(self, learned: dict[str, float]):
        super().__init__()
        self.learned = learned
        self.fixed = {w: (c, 1.0) for c, words in ((TARGET, TARGETS), (SUBJECT, SUBJECTS), (COPULA, COPULAS), (ADDRESS, ADDRESSES), (MODAL, MODALS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (HARM, HARMS), ("t m", FUTURES), (INSULT, INSULTS), (QUOTE, QUOTES), (END, ENDS)) for w in words}

    def __missing__(self, word: str):
        if len(self) > 500_000:
            self.clear()
        low = word.lower().replace("’", "'")
        made = self.fixed.get(low)
        if made is None or made[0][0] in (HARM, INSULT):
            weight = max((self.learned[k] for k in (low + "$", *(low[:n] for n in STEM if n <= len(low))) if k in self.learned), default=None)
            if weight is not None:
                made = (INSULT, weight)
        made = self[word] = made or (OTHER, 0.0)
        return made


def marks(text: str, lexicon: Lexicon, machine: Transducer, behind: Transducer) -> Counter:
    """Weights of the clause patterns of a whole text, read both ways."""
    found: Counter = Counter()
    read = list(map(lexicon.__getitem__, TOKEN.findall(text)))
    classes = [c for c, _ in read]
    if INSULT not in classes and HARM not in classes and "t m" not in classes:
        return found
    back = list(behind.run(reversed(classes)))[::-1]
    for (c, weight), out, more in zip(read, machine.run(classes), back, strict=True):
        if c[0] in (INSULT, HARM):
            found[pattern("".join(b if a == " " else a for a, b in zip(out.ljust(4), more.ljust(4), strict=True)))] += weight
    return found


def vector(found: Counter) -> list[float]:
    return [math.log1p(found.get(m, 0.0)) / math.log(2) for m in MARKS]


def forms(text: str) -> list[str]:
    """Word forms (ending in $) and stems of a text, each once."""
    words = {w.lower() for w in TOKEN.findall(text) if w[0].isalpha()}
    return list({w + "$" for w in words} | {w[:n] for w in words for n in STEM if n <= len(w)})


def learn_lexicon(rows: DataFrame, sizes: tuple[int, int], least: int = 3, share: float = 0.01, purity: float = 0.9) -> dict[str, float]:
    """The fewest forms and stems, hardly seen but in toxic documents, that explain these; with weights.

    Candidates are counted over the distinct texts of the sample, so that copies of one text count
    once. Then a greedy cover: the candidate that most of the toxic texts not yet explained hold is
    taken, as long as it explains enough of them; what the fixed lexicon matches is explained. All that
    are frequent and pure enough are candidates: as the sample is bounded and each must occur in
    ``share`` of its toxic texts, so is their number.
    """
    toxic, clean = sizes
    texts = rows.select("label", "text").distinct()
    seen = map_texts(texts, "text", lambda: lambda ts: {"forms": [forms(t) for t in ts]}, [T.StructField("forms", T.ArrayType(T.StringType()))])
    counts = seen.select("label", F.explode("forms").alias("form")).groupBy("form").agg(F.sum("label").alias("bad"), F.sum(1 - F.col("label")).alias("good"))
    rate = (F.col("bad") / max(1, toxic)) / (F.col("bad") / max(1, toxic) + (F.col("good") + 0.25) / max(1, clean))
    enough = max(least, math.ceil(share * toxic))
    few = counts.where(F.col("bad") >= enough).withColumn("rate", rate).where(F.col("rate") >= purity)
    top = {r["form"]: (r["bad"], r["good"], r["rate"]) for r in few.orderBy(F.col("bad").desc(), F.length("form"), "form").collect()}
    names = sorted(top)
    index = {f: i for i, f in enumerate(names)}

    def make():
        plain = Lexicon({})
        return lambda ts: {"held": [[] if any(plain[w][0] == INSULT for w in TOKEN.findall(t)) else [index[f] for f in forms(t) if f in index] for t in ts]}

    held = map_texts(texts.where("label = 1"), "text", make, [T.StructField("held", T.ArrayType(T.IntegerType()))]).select("held").collect()
    left = [set(r["held"]) for r in held if r["held"]]
    chosen: dict[str, float] = {}
    while left:
        tally = Counter(i for x in left for i in x)
        best = min(tally, key=lambda i: (-tally[i], top[names[i]][1], len(names[i]), names[i]))
        if tally[best] < enough:
            break
        chosen[names[best]] = 0.5 + 0.5 * top[names[best]][2]
        left = [x for x in left if best not in x]
    return chosen


def fit_weights(x: np.ndarray, y: np.ndarray, weights: np.ndarray, pull: float = 2.0, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression by Newton's method, drawn towards the prior weights."""
    prior = np.array([PRIOR[m] for m in MARKS] + [BIAS])
    w = prior.copy()
    full = np.hstack([x, np.ones((len(x), 1))])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(full @ w, -40, 40)))
        slope = full.T @ ((p - y) * weights) + pull * (w - prior)
        curve = (full * (p * (1 - p) * weights)[:, None]).T @ full + pull * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w[: len(MARKS)] = np.maximum(w[: len(MARKS)], 0)  # a match never speaks for a clean text
    strong = np.array([PRIOR[m] > -BIAS for m in MARKS])
    w[: len(MARKS)][strong & ~x.any(0)] += max(0.0, BIAS - w[-1])  # strong patterns not seen keep their prior score, not only their weight
    return ordered(w[:-1]), float(w[-1])


def ordered(weights: np.ndarray) -> np.ndarray:
    """The weights with a fuller pattern above a barer one, and below it when negated or reported."""
    w = dict(zip(MARKS, weights.tolist(), strict=True))
    for kind in "it":
        for bare, full in ((" ", "a"), ("a", "c")):
            w[kind + full + " "] = max(w[kind + full + " "], w[kind + bare + " "] + STEP)
        for form, what in product(" ac", "nr"):
            w[kind + form + what] = min(w[kind + form + what], max(0.0, w[kind + form + " "] - SCOPE_COST))
    w["t  "] = w["t n"] = w["t r"] = 0.0
    return np.array([w[m] for m in MARKS])


def fit(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (5, 0), each: int = 5000):
    """(lexicon, weights of the marks, bias), from at most ``each`` documents of either class."""
    rows, sizes = sample(docs, labels, "toxic", held, each)
    n = {int(r["label"]): int(r["count"]) for r in rows.df.select("label", "text").distinct().groupBy("label").count().collect()}
    learned = learn_lexicon(rows.df, (n.get(1, 0), n.get(0, 0)))

    def make():
        lexicon, machine, behind = Lexicon(learned), grammar(), backward()
        return lambda texts: {"x": [vector(marks(t, lexicon, machine, behind)) for t in texts]}

    got = map_texts(rows.df, "text", make, [T.StructField("x", T.ArrayType(T.DoubleType()))]).toPandas()
    rows.drop()
    y = got["label"].to_numpy(float)
    if not len(y):
        return learned, np.array([PRIOR[m] for m in MARKS]), BIAS
    factor = np.array([sizes.get(c, 0) / max(1.0, float((y == c).sum())) for c in (0, 1)])
    x = np.array(got["x"].tolist()).reshape(len(y), len(MARKS))
    return learned, *fit_weights(x, y, factor[y.astype(int)] / factor[y.astype(int)].mean())


def with_score(docs: DataFrame, model, text: str = "text", name: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with the toxicity of each whole text; null and empty texts match nothing.

    The lexicon that goes to the workers holds at most one learned form for each toxic text of the sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        learned, weights, bias = shared.value
        lexicon, machine, behind = Lexicon(learned), grammar(), backward()
        w = weights.tolist()

        def score(t):
            found = marks(t, lexicon, machine, behind)
            z = bias + (sum(a * b for a, b in zip(vector(found), w, strict=True)) if found else 0.0)
            return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))

        return lambda texts: {name: [score(t) for t in texts]}

    return map_texts(docs, text, make, [T.StructField(name, T.DoubleType())], keep_text)


def classify(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (5, 0), threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null ids are kept and never held out; repeated rows get equal scores; without labels the fixed
    lexicon and the prior weights hold; an empty table gives an empty result. Other columns play no part.
    """
    model = fit(docs, labels, held)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id", *held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
