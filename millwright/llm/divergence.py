"""How the word use of sources of a language differs: audited pair by pair and term by term, in exact arithmetic.

A pair of sources is compared over all kept terms of its language, most of which either source lacks.
Instead of a row for each (pair, term), each pair gets a histogram of its distinct (count, count)
combinations. Terms that both sources have are tallied from the terms' rows, equal rows once; the cells
in which a count is zero follow from the sources' own histograms and the number of kept terms. The
divergence is then worked out once for each combination, times how often it occurs.
"""

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millwright.store import cut

#: Entries that one task counts before it hands them on.
MOST_ENTRIES = 400_000
SCALE = 1_000_000_000

#: A byte of a term stays, A-Z in lower case; any other byte becomes a space.
_LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters and characters beyond ASCII, A-Z lower-cased. No such character's bytes are ASCII."""
    return text.translate(_LETTERS).split()


def term_counts(docs: DataFrame, least_docs: int) -> DataFrame:
    """(lang, source, term, count, total, first): occurrences of the terms that at least ``least_docs`` documents of
    their language hold. ``total`` is the language's, and one row of each (lang, term) is its ``first``.

    Counted per task in tables of bounded size, so that a frequent term or a large source is a few rows a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict = {}
        held = 0

        def rows():
            for (lang, source), (count, docs_) in uses.items():
                if count:
                    names = pa.array(list(count), pa.binary()).cast(pa.string())
                    keys = [pa.array([x] * len(count), pa.string()) for x in (lang, source)]
                    yield pa.RecordBatch.from_arrays([*keys, names, pa.array(count.values(), pa.int64()), pa.array([docs_[t] for t in count], pa.int64())], names=["lang", "source", "term", "count", "docs"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                own = uses.setdefault((lang, source), (Counter(), Counter()))
                found = terms(text.as_buffer().to_pybytes())
                before = len(own[0])
                own[0].update(found)
                own[1].update(set(found))
                held += len(own[0]) - before
                if held >= MOST_ENTRIES:
                    yield from rows()
                    uses, held = {}, 0
        yield from rows()

    parts = docs.mapInArrow(run, "lang string, source string, term string, count long, docs long").repartition("lang", "term")
    whole = parts.groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    w = Window.partitionBy("lang", "term")  # a term's sources; the partitioning is the aggregate's
    spread = whole.select("lang", "source", "term", "count", F.sum("count").over(w).alias("total"), F.sum("docs").over(w).alias("_docs"), (F.row_number().over(w.orderBy("source")) == 1).alias("first"))
    return spread.where(F.col("_docs") >= least_docs).drop("_docs")


def share(count, total, kept) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + kept)), exact."""
    return F.expr(f"1 + (cast({SCALE} as decimal(18, 0)) * cast({count} + 1 as decimal(19, 0))) div cast({total} + {kept} as decimal(20, 0))")


def apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / q); shares are at most SCALE + 1, so that the square fits into a long."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def joint_histogram(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, a, b, x, y, n), a < b: how many kept terms of ``lang`` occur x times in source a and y times in b, n > 0;
    a language without kept terms has one cell (0, 0) of n = 0 for each pair.

    ``cells`` are (lang, source, term, count), ``groups`` (lang, source, kept). Terms with one and the same
    row of counts are taken once. Zero cells by inclusion and exclusion: a term of both sources
    leaves the cells in which either alone was counted.
    """
    rows = cells.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("source", "count"))).alias("row"))  # one entry a source
    rows = rows.groupBy("lang", "row").agg(F.count("*").alias("n"))
    lead = rows.select("lang", "n", "row", F.posexplode("row").alias("_i", "l"))
    met = lead.select("lang", "n", "l", F.explode(F.expr("slice(row, _i + 2, size(row))")).alias("r"))
    both = met.groupBy("lang", F.col("l.source").alias("a"), F.col("r.source").alias("b"), F.col("l.count").alias("x"), F.col("r.count").alias("y")).agg(F.sum("n").alias("n"))
    pairs = groups.select("lang", F.col("source").alias("a"), "kept").join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b")  # the result's own rows
    own = cells.groupBy("lang", "source", "count").agg(F.count("*").alias("n"))
    of_a = own.withColumnRenamed("source", "a").join(pairs.drop("kept"), ["lang", "a"]).withColumn("part", F.lit("a"))
    of_b = own.withColumnRenamed("source", "b").join(pairs.drop("kept"), ["lang", "b"]).withColumn("part", F.lit("b"))
    zero = F.lit(0).cast("long")
    parts = both.select("lang", "a", "b", "x", "y", "n", F.lit("both").alias("part"))
    parts = parts.unionByName(of_a.select("lang", "a", "b", F.col("count").alias("x"), zero.alias("y"), "n", "part"))
    parts = parts.unionByName(of_b.select("lang", "a", "b", zero.alias("x"), F.col("count").alias("y"), "n", "part"))
    parts = parts.unionByName(pairs.select("lang", "a", "b", zero.alias("x"), zero.alias("y"), F.col("kept").alias("n"), F.lit("none").alias("part")))
    signed = F.expr("""case part when 'both' then array(named_struct('x', x, 'y', y, 'n', n), named_struct('x', x, 'y', 0L, 'n', -n), named_struct('x', 0L, 'y', y, 'n', -n), named_struct('x', 0L, 'y', 0L, 'n', n))
        when 'none' then array(named_struct('x', x, 'y', y, 'n', n)) else array(named_struct('x', x, 'y', y, 'n', n), named_struct('x', 0L, 'y', 0L, 'n', -n)) end""")
    tallied = parts.select("lang", "a", "b", F.explode(signed).alias("s")).groupBy("lang", "a", "b", F.col("s.x").alias("x"), F.col("s.y").alias("y")).agg(F.sum("s.n").alias("n"))
    return tallied.where("n > 0 or (x = 0 and y = 0)")


def audit(docs: DataFrame, least_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) its divergence from each other source of the language
    (part ``pair``), and the ``top_terms`` terms it uses more than its language does (part ``term``).

    Null text, lang or source count as ''. Every row is a document, repeated ones too; other columns
    don't matter. A language with one source has no pairs; one without kept terms has pairs of value 0;
    an empty table has no rows. Ties are ranked by the item's UTF-8 bytes. Of each group's terms only the
    first ``top_terms`` leave a task.
    """
    given = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    cells = cut(term_counts(given, least_docs), "term-counts")
    sizes = cells.groupBy("lang").agg(F.count_if("first").alias("kept"), F.sum("count").alias("all"))
    own = cells.groupBy("lang", "source").agg(F.sum("count").alias("own"))
    zero = F.lit(0).cast("long")
    groups = given.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = cut(groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("own", "kept", "all")]), "groups")
    size = groups.select("lang", F.col("source").alias("a"), F.col("own").alias("own_a"), "kept")
    told = joint_histogram(cells.select("lang", "source", "term", "count"), groups.select("lang", "source", "kept"))
    told = told.join(size, ["lang", "a"]).join(size.select("lang", F.col("a").alias("b"), F.col("own_a").alias("own_b")), ["lang", "b"])
    # nothing is kept where n = 0, and there may be nothing to divide by
    told = told.withColumn("p", F.when(F.col("n") > 0, share("x", "own_a", "kept"))).withColumn("q", F.when(F.col("n") > 0, share("y", "own_b", "kept")))
    sums = told.groupBy("lang", "a", "b").agg(F.coalesce(F.sum(F.col("n") * apart("p", "q")), zero).alias("ab"), F.coalesce(F.sum(F.col("n") * apart("q", "p")), zero).alias("ba"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), F.col("ab").alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), F.col("ba").alias("value"))))
    pairs = sums.select("lang", both.alias("r")).select("lang", "r.*")
    used = cells.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), share("count", "own", "kept").alias("p"), share("total", "all", "kept").alias("q"))
    more = used.where("p > q").select("lang", "source", "item", apart("p", "q").alias("value"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs, more = pairs.withColumn("rank", place), more.withColumn("rank", place).where(F.col("rank") <= top_terms)
    parts = [x.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank") for name, x in (("pair", pairs), ("term", more))]
    return parts[0].unionByName(parts[1])


SQL = r"""WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lc FROM w GROUP BY ALL HAVING count(DISTINCT i) >= 3),
c AS (SELECT w.lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v, sum(lc) AS n FROM k GROUP BY 1),
o AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
p AS (SELECT o.lang, o.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (o.n + v.v) AS BIGINT) AS p, CAST(1 + (1000000000::HUGEINT * (k.lc + 1)) // (v.n + v.v) AS BIGINT) AS q
FROM o JOIN k ON k.lang = o.lang JOIN v ON v.lang = o.lang LEFT JOIN c ON c.lang = o.lang AND c.source = o.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pr AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
t AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE c > 0 AND p > q),
u AS (SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pr
UNION ALL SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) FROM t)
SELECT * FROM u WHERE part = 'pair' OR rank <= 200"""
