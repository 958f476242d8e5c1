"""Personal data: spans that fixed rules find, and look-alikes that boosted trees take for the same.

Rules find e-mail and network addresses, card and phone numbers. High-recall generators propose spans of
the same kinds in wider spellings ("name [at] host [dot] org", "10[.]0[.]0[.]1", cards with other
separators, phones without a plus), which may overlap. Boosted trees, one forest a kind, learn from all
documents to tell the rules' own spans from other candidates: they see the format of the normalized value and the
context, but not what the rule decides by (checksum, range, plus sign, the spelling of @ and dot). A candidate
clear of all rules' spans is added if its score reaches the kind's threshold, set by forests that didn't see the row
so that nearly all above it are the rules' own; of overlapping additions the better scored stays.

Everything is Column expressions; a document's spans are made in its own row, and no text is shuffled. Places
come from the lengths of a text's pieces between matches, summed in blocks. Patterns take what they can
without giving back, so that long runs need neither deep recursion nor quadratic time.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.llm import boosting
from millwright.store import Cut

# fixed values: kinds in their order, what the rules match, and the digits they allow
KINDS = ("email", "ip", "card", "phone")
LOCAL, HOST = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
DIGITS = {"card": (12, 19), "phone": (9, 15)}
BYTES = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.|$)){4}$"

_AT = r"(?:\x20?@\x20?|\x20?[\[({<]\x20?(?:at|AT|@)\x20?[\])}>]\x20?|\x20AT\x20)"
_DOT = r"(?:\.|\x20?[\[({<]\x20?(?:dot|DOT|\.)\x20?[\])}>]\x20?|\x20DOT\x20|\x20dot\x20)"
#: Generators: wider than the rules, leftmost non-overlapping of each kind.
WIDE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++(?:{_AT}|\x20at\x20(?={HOST}++\x20dot\x20)){HOST}++(?:{_DOT}{HOST}++)*+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:[\[(]?\.[\])]?[0-9]++){2,6}+",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}+[0-9]){10,}+",
    "phone": r"(?<![0-9])(?:\+|\()?[0-9](?:[\x20()./-]{0,3}+[0-9]){6,}+",
}
#: A text without any of these has no span and no candidate.
ANY = r"[0-9]{3}|[0-9][\x20()\[\]._/-]+[0-9]|@|[\[({<]\x20?(?:at|AT)\x20?[\])}>]|\x20AT\x20|\x20at\x20[A-Za-z0-9-]+\x20dot\x20"
#: Words before a candidate that tell its kind.
CUES = {
    "email": r"(?i)mail|correo|courriel|contact|kontakt|write|schreib",
    "ip": r"(?i)\bip\b|host|server|address|adress|direcci",
    "card": r"(?i)card|karte|carte|tarjeta|visa|credit|kredit|payment",
    "phone": r"(?i)phone|telefon|\btel|call|fax|mobil|\bruf|appel",
}
#: Chars of context on either side, and spans that are looked through or summed at once.
BEFORE, AFTER, BLOCK = 24, 8, 64
FEATURES = ("digits", "letters", "marks", "mark_kinds", "groups", "longest", "first_group", "last_group", "parts", "left", "right", "assigned", "own_cue", "other_cue")
PLACE, CANDIDATE = "array<struct<s:bigint,k:int,e:bigint>>", "array<struct<k:int,s:bigint,e:bigint," + ",".join(f"{f}:int" for f in FEATURES) + ">>"


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column) -> Column:
    return F.aggregate(values, F.array().cast("array<bigint>"), lambda a, x: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)) + x)))


def blocks(values: Column) -> Column:
    """``values``, not empty, in arrays of BLOCK."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))


def prefix_sums(values: Column) -> Column:
    """Running sums, first within blocks and then over the blocks' sums."""
    ends = lambda inner: running(F.transform(inner, lambda x: F.element_at(x, -1)))
    moved = lambda inner, upto: F.flatten(F.transform(inner, lambda x, j: F.transform(x, lambda y: y + F.when(j > 0, upto[j - 1]).otherwise(0))))
    return let(F.transform(blocks(values), running), lambda inner: let(ends(inner), lambda upto: moved(inner, upto)))


def matches(text: Column, pattern: str) -> Column:
    """Array of (s, e, v, l, r): matches of ``pattern`` in code points, end exclusive, and what stands before and after
    each, at most up to the neighbouring match."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"), F.split(text, pattern, -1).alias("gaps"))

    def place(g):
        steps = F.transform(g.hits, lambda h, i: (F.length(g.gaps[i]) + F.when(i > 0, F.length(g.hits[i - 1])).otherwise(0)).cast("bigint"))
        row = lambda starts: F.transform(g.hits, lambda h, i: F.struct(starts[i].alias("s"), (starts[i] + F.length(h)).alias("e"), h.alias("v"), F.right(g.gaps[i], F.lit(BEFORE)).alias("l"), F.left(g.gaps[i + 1], F.lit(AFTER)).alias("r")))
        return F.when(F.size(g.hits) > 0, let(let(steps, prefix_sums), row)).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,v:string,l:string,r:string>>"))

    return let(found, place)


def holds(kind: str, value: Column) -> Column:
    """Whether the rule of ``kind`` accepts what its pattern matched."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(BYTES)
    digits = F.regexp_replace(value, "[^0-9]", "")
    right_length = F.length(digits).between(*DIGITS[kind])
    return right_length & F.when(right_length, F.call_function("luhn_check", digits)).otherwise(False) if kind == "card" else right_length


def ruled(text: Column, kind: str) -> Column:
    return F.filter(matches(text, BASE[kind]), lambda m: holds(kind, m.v))


def described(kind: str, m: Column) -> Column:
    """(k, s, e, features) of a match. The value is normalized first, and the plus sign is left out."""
    v = m.v
    if kind == "email":
        v = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, _AT, "@"), r"\x20at\x20", "@"), _DOT, ".")
    elif kind == "ip":
        v = F.regexp_replace(v, r"[\[\]()]", "")
    else:
        v = F.regexp_replace(F.regexp_replace(v, r"\+", ""), "[._/]", "-")

    def features(w, runs):
        size = lambda x, most: F.least(F.coalesce(F.length(x), F.lit(0)), F.lit(most))
        side = lambda c: F.when(c.rlike("[A-Za-z]"), 1).when(c.rlike("[0-9]"), 2).when(c.rlike("[\"'=]"), 3).when(c.rlike(r"\S"), 4).otherwise(0)
        cue = lambda k: m.l.rlike(CUES[k])
        got = {
            "digits": size(F.regexp_replace(w, "[^0-9]", ""), 24),
            "letters": size(F.regexp_replace(w, "[^A-Za-z]", ""), 24),
            "marks": size(F.regexp_replace(w, "[A-Za-z0-9@.]", ""), 8),
            "mark_kinds": sum((w.contains(x).cast("int") for x in "-("), w.contains(" ").cast("int")),
            "groups": F.least(F.size(runs), F.lit(8)),
            "longest": F.coalesce(F.array_max(F.transform(runs, lambda x: size(x, 24))), F.lit(0)),
            "first_group": size(F.try_element_at(runs, F.lit(1)), 24),
            "last_group": size(F.try_element_at(runs, F.lit(-1)), 24),
            "parts": F.least(F.size(F.split(w, r"\.")), F.lit(8)),
            "left": side(F.right(m.l, F.lit(1))),
            "right": side(F.left(m.r, F.lit(1))),
            "assigned": m.l.rlike("[=:]\\s*[\"']?$").cast("int"),
            "own_cue": cue(kind).cast("int"),
            "other_cue": reduce(lambda a, b: a | b, [cue(k) for k in KINDS if k != kind]).cast("int"),
        }
        return F.struct(F.lit(KINDS.index(kind)).alias("k"), m.s.alias("s"), m.e.alias("e"), *[got[f].alias(f) for f in FEATURES])

    return let(v, lambda w: let(F.regexp_extract_all(w, F.lit("[0-9]+"), F.lit(0)), lambda runs: features(w, runs)))


def all_described(found: dict) -> Column:
    """Descriptions of kind -> matches, one array."""

    def of(kind):
        return F.transform(found[kind], lambda m: described(kind, m))

    return F.concat(*map(of, KINDS))


def overlaps(spans: Column, m: Column) -> Column:
    """Whether ``m`` overlaps one of ``spans``, which are in blocks (lo, hi, own)."""
    return F.exists(spans, lambda b: (b.lo < m.e) & (b.hi > m.s) & F.exists(b.own, lambda x: (x.s < m.e) & (x.e > m.s)))


def in_blocks(spans: Column) -> Column:
    made = F.transform(blocks(spans), lambda b: F.struct(F.array_min(F.transform(b, lambda x: x.s)).alias("lo"), F.array_max(F.transform(b, lambda x: x.e)).alias("hi"), b.alias("own")))
    return F.when(F.size(spans) > 0, made).otherwise(F.array().cast(f"array<struct<lo:bigint,hi:bigint,own:{PLACE}>>"))


def _places(text: Column) -> Column:
    """(s, k, e) of all spans that the rules find, by start and then kind."""

    def of(k):
        return F.transform(ruled(text, KINDS[k]), lambda m: F.struct(m.s.alias("s"), F.lit(k).alias("k"), m.e.alias("e")))

    return F.array_sort(F.concat(*map(of, range(len(KINDS)))))


def proposed(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with _base, the rules' spans, and _wide, the described candidates clear of them. Null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    some = t.rlike(ANY)
    made = docs.withColumn("_base", F.when(some, _places(t)).otherwise(F.array().cast(PLACE)))
    made = made.withColumn("_held", in_blocks(F.col("_base")))
    clear = {k: F.filter(matches(t, WIDE[k]), lambda m: ~overlaps(F.col("_held"), m)) for k in KINDS}
    return made.withColumn("_wide", F.when(some, all_described(clear)).otherwise(F.array().cast(CANDIDATE))).drop("_held")


class Model:
    """A forest and a threshold for each kind that has them; ``score`` is the SQL of a candidate's margin over its threshold."""

    def __init__(self, forests: dict, thresholds: dict):
        self.forests, self.thresholds = forests, thresholds

    def over(self, candidate: str) -> str:
        names = [f"{candidate}.{f}" for f in FEATURES]
        known = [f"when {k} then {self.forests[k].margin(names)} - {low!r}D" for k, low in sorted(self.thresholds.items())]
        return f"case {candidate}.k {' '.join(known)} end" if known else "cast(null as double)"


def vectors(docs: DataFrame, text: str) -> DataFrame:
    """(k, features, half, n, y): distinct descriptions of the rules' spans (label 1) and of other candidates (label 0)."""
    made = proposed(docs, text)
    t = F.coalesce(F.col(text), F.lit(""))
    own = all_described({k: ruled(t, k) for k in KINDS})
    rows = made.select("_half", F.explode(F.array(F.struct(F.lit(1).alias("y"), own.alias("of")), F.struct(F.lit(0).alias("y"), F.col("_wide").alias("of")))).alias("p"))
    rows = rows.select("_half", F.col("p.y").alias("y"), F.explode("p.of").alias("c"))
    return rows.groupBy(F.col("_half").alias("half"), "c.k", *[f"c.{f}" for f in FEATURES]).agg(F.count("*").alias("n"), F.sum("y").alias("y"))


def learn(docs: DataFrame, text: str = "text", sample: int | None = None, precision: float = 0.9, **grow) -> Model:
    """A model from all documents that hold any candidate; with ``sample``, from about so many of them, drawn by a hash
    of the text and what else is in the row.

    Forests grow on either half of the documents, parted by a hash of the text, and on all of them. The halves' forests
    score each other's documents, and these scores, of all documents, set the thresholds of the last ones. A kind without
    both labels in either half, or that reaches no ``precision``, gets no threshold, and nothing is added for it.
    """
    some = docs.where(F.col(text).rlike(ANY))
    if sample:
        share = sample / max(sample, some.count())
        some = some.where(F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 40)) < int(share * (1 << 40)))
    told = Cut(vectors(some.withColumn("_half", F.pmod(F.xxhash64(text, F.lit("fold")), F.lit(2)).cast("int")), text), "pii-vectors")
    # groups of a kind: 3 k and 3 k + 1 for its halves, 3 k + 2 for both
    grown = told.df.withColumn("g", F.explode(F.array(F.col("k") * 3 + F.col("half"), F.col("k") * 3 + 2)))
    forests = boosting.fit(grown, "g", list(FEATURES), **grow)
    kinds = [k for k in range(len(KINDS)) if all(g in forests and forests[g].trees for g in range(3 * k, 3 * k + 3))]
    margins = " ".join(f"when {3 * k + half} then {forests[3 * k + half].margin(list(FEATURES))}" for k in kinds for half in (0, 1))
    tests = told.df.where(F.col("k").isin(kinds))
    thresholds = boosting.threshold(tests.withColumn("_m", F.expr(f"case k * 3 + 1 - half {margins} end")), "k", "_m", precision) if kinds else {}
    told.drop()
    return Model({k: forests[3 * k + 2] for k in kinds}, thresholds)


def find(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, base), in code points, by start, then kind, then end.

    Null and empty texts have no spans. Rows are independent, so repeated rows have equal spans. A column
    ``spans`` of ``docs`` is replaced; other columns and an empty table pass through.
    """
    kept = [c for c in docs.columns if c != "spans"]
    made = proposed(docs.select(*kept), text)
    over = F.expr(f"filter(transform(_wide, c -> named_struct('s', c.s, 'k', c.k, 'e', c.e, 'over', {model.over('c')})), c -> c.over >= 0)")
    # from the left: what overlaps the addition before it stays only if it is the better one
    sweep = """aggregate(array_sort(_more), cast(array() as array<struct<s:bigint,k:int,e:bigint,over:double>>),
        (a, x) -> if(size(a) = 0 or element_at(a, -1).e <= x.s, concat(a, array(x)), if(element_at(a, -1).over >= x.over, a, concat(slice(a, 1, size(a) - 1), array(x)))))"""
    made = made.withColumn("_more", over).withColumn("_more", F.expr(sweep))
    both = F.array_sort(F.concat(F.transform("_base", lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"), F.lit(True).alias("b"))), F.transform("_more", lambda x: F.struct(x.s.alias("s"), x.k.alias("k"), x.e.alias("e"), F.lit(False).alias("b")))))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(both, lambda x: F.struct(names[x.k].alias("kind"), x.s.alias("start"), x.e.alias("end"), x.b.alias("base")))
    return made.select(*[F.col(c) for c in kept], spans.alias("spans"))


def redacted(text: str = "text", spans: str = "spans") -> Column:
    """The text with each span replaced by its kind in brackets; spans that overlap, by the first one's."""
    t, sorted_ = F.coalesce(F.col(text), F.lit("")), F.col(spans)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, x: F.when(x.start < a["at"], F.struct(F.greatest(a["at"], x.end).alias("at"), a["out"].alias("out"))).otherwise(F.struct(x.end.alias("at"), F.concat(a["out"], F.array(F.substring(t, a["at"] + 1, x.start - a["at"]), F.concat(F.lit("["), x.kind, F.lit("]")))).alias("out")))
    return F.aggregate(sorted_, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    written = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    base = F.filter("spans", lambda s: s.base)

    def n(kind):
        return F.size(F.filter(base, lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(n, KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
