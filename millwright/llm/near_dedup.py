"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles. Each set gets a sketch: for every register the least of the
elements' exponential variates, kept as its exponent to a base near 1, cut off at both ends. Registers
of a union are the larger of both, and two sets agree in a register with a chance close to their
likeness, so that bands of ``ROWS`` registers bring alike sets into one bucket.

Equal sets are one vertex. In a bucket the likeness of two vertices is estimated by maximum likelihood
from the registers that are equal, larger and smaller together with the exact set sizes; pairs that
could reach the threshold are confirmed on the full sets. Pairs are not enumerated first: in the first
round each vertex names its likeliest partner in a bucket, those pairs are confirmed and components are
joined. Only buckets that hold several components go on to the second round, with their full sets.
There every pair between components that could reach the threshold is confirmed inside its tile, and
a tile gives only links that join components which it has not joined yet. A large bucket is dealt over
tiles of bounded numbers of vertices and of elements. So no link between components is lost to a
limit, and links inside one component need no confirming.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.batches import resident, vacate
from millwright.llm.bitmaps import bitmap, has, packed, unpacked
from millwright.llm.components import components
from millwright.llm.rolling import R, mix
from millwright.store import Cut, cut

BANDS, ROWS = 27, 4
REGISTERS = BANDS * ROWS
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
#: vertices and set elements of one side of a tile
TILE, ELEMENTS = 2000, 2_000_000
#: elements that are compared with one set at a time
BLOCK = 1_000_000
#: likelihood ratio up to which a pair may reach the threshold: 5 standard deviations
DOUBT = 25.0
MAX_WORDS = 500_000
_A = np.random.default_rng(5).integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, size: int) -> np.ndarray:
    """The distinct 64-bit hashes, sorted, of the ``size``-word shingles; of a shorter text, of all words."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    known = resident("shingle words", dict)
    if len(known) > MAX_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * R + h[k : len(h) - n + 1 + k]
        out ^= out >> np.uint64(32)
    return np.unique(mix(out))


def vertex(elements: np.ndarray) -> bytes:
    """128 bits that stand for the set."""
    return int(elements.sum(dtype=np.uint64)).to_bytes(8, "big") + int(mix(elements ^ R).sum(dtype=np.uint64)).to_bytes(8, "big")


def sketch(elements: np.ndarray) -> np.ndarray:
    """SetSketch registers as 16-bit numbers; larger means a smaller minimum."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(elements), 4096):
        x = elements[at : at + 4096, None] * _A
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        least = np.minimum(least, x.min(0))
    e = -np.log1p(-(least >> np.uint64(11)).astype(float) / (1 << 53)) / RATE
    with np.errstate(divide="ignore"):
        return np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, TOP).astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def band_keys(registers: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row of registers; the band counts in it."""
    x = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * R
    for k in range(ROWS):
        h = mix(h + x[:, :, k])
    return h


_GRID = np.linspace(0.02, 0.995, 79)


def _likelihood(j, equal, more, less, u, v):
    """Log likelihood of the likeness ``j`` of two sets with the shares u, v of the sum of their sizes."""
    a, b = np.maximum(u - v * j, 1e-9), np.maximum(v - u * j, 1e-9)
    return equal * np.log(j) + more * np.log(a) + less * np.log(b)


def estimate(equal, more, less, size_a, size_b, least: float):
    """(most likely likeness, whether ``least`` is within doubt) of pairs, as arrays."""
    total = (size_a + size_b).astype(float)
    u, v = size_a / total, size_b / total
    bound = np.minimum(size_a, size_b) / np.maximum(size_a, size_b)
    best, at = np.full(len(equal), -np.inf), np.zeros(len(equal))
    for j in _GRID:
        x = np.where(j <= bound, _likelihood(np.minimum(j, bound), equal, more, less, u, v), -np.inf)
        at = np.where(x > best, j, at)
        best = np.maximum(best, x)
    there = _likelihood(np.minimum(least, bound), equal, more, less, u, v)
    possible = (at >= least) | (2 * (best - there) <= DOUBT)
    return at, possible & (bound >= least - 1e-9)


VERTEX = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("h", T.LongType()), T.StructField("v", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("registers", T.BinaryType())])


def _texts(batch, name="text"):
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def sketches(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, the text's hash, vertex, set size and registers; the last three are empty for empty sets."""
    import pyarrow as pa

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                vs, ns, rs = [], [], []
                for t in _texts(batch):
                    s = shingles(t, size)
                    ns.append(len(s))
                    vs.append(vertex(s) if len(s) else None)
                    rs.append(sketch(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), batch.column(batch.schema.get_field_index("h")), pa.array(vs, pa.binary()), pa.array(ns, pa.int64()), pa.array(rs, pa.binary())], names=VERTEX.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, VERTEX)


def _bands(vertices: DataFrame, open_: np.ndarray | None) -> DataFrame:
    """(band, id, v, n) of each vertex and band; with a bitmap only of keys that it holds."""
    import pyarrow as pa

    shared = vertices.sparkSession.sparkContext.broadcast(packed(open_))
    schema = T.StructType([T.StructField("id", T.LongType())] + ([T.StructField("band", T.IntegerType()), T.StructField("v", T.BinaryType()), T.StructField("n", T.LongType())] if open_ is not None else []))

    def run(batches):
        vacate()
        bits = unpacked(shared.value)
        for batch in batches:
            v, n = (batch.column(batch.schema.get_field_index(k)) for k in ("v", "n"))
            raw = batch.column(batch.schema.get_field_index("registers"))
            if not batch.num_rows:
                continue
            keys = band_keys(np.frombuffer(b"".join(raw.to_pylist()), "<u2").reshape(-1, REGISTERS))
            if bits is None:
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64))], names=schema.names)
                continue
            on = has(bits, keys.ravel())
            at = np.flatnonzero(on)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()[on].view(np.int64)), pa.array((at % BANDS).astype(np.int32)), v.take(pa.array(at // BANDS)), n.take(pa.array(at // BANDS))], names=schema.names)

    return vertices.mapInArrow(run, schema)


def _full_sets(docs: DataFrame, size: int, wanted: np.ndarray) -> DataFrame:
    """(v, elements), each vertex once, of the texts whose hashes a bitmap holds."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(packed(wanted))
    schema = T.StructType([T.StructField("v", T.BinaryType()), T.StructField("elements", T.ArrayType(T.LongType()))])

    def run(batches):
        given, bits = set(), unpacked(shared.value)
        for batch in batches:
            h = batch.column(batch.schema.get_field_index("h")).to_numpy()
            text = batch.column(batch.schema.get_field_index("text"))
            at = [i for i in np.flatnonzero(has(bits, h.view(np.uint64))).tolist() if text[i].is_valid]
            for start in range(0, len(at), 500):
                vs, es = [], []
                for i in at[start : start + 500]:
                    if h[i] in given:
                        continue
                    if len(given) < 1_000_000:
                        given.add(int(h[i]))
                    s = shingles(text[i].as_py(), size)
                    if len(s):
                        vs.append(vertex(s))
                        es.append(s.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(vs, pa.binary()), pa.array(es, pa.list_(pa.int64()))], names=schema.names)

    return docs.select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, schema).groupBy("v").agg(F.first("elements").alias("elements"))


def _possible(group: dict, band: int, least: float):
    """(x, y, estimate) of the pairs of a tile between components that could reach ``least``, in blocks
    of vertices x. A pair belongs to the first band that holds it."""
    x, y = np.flatnonzero(group["is_x"]), np.flatnonzero(group["is_y"])
    regs, n, comp, both = group["registers"], group["n"], group["comp"], group["is_x"] & group["is_y"]
    step = max(1, 4_000_000 // (REGISTERS * max(1, len(y))))
    for at in range(0, len(x), step):
        xs = x[at : at + step]
        i, j = np.divmod(np.arange(len(xs) * len(y)), len(y))
        i, j = xs[i], y[j]
        ok = (comp[i] != comp[j]) & ~(both[i] & both[j] & (i > j)) & (np.minimum(n[i], n[j]) >= (least - 1e-9) * np.maximum(n[i], n[j]))
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        a, b = regs[i], regs[j]
        same = a == b
        equal = same.sum(1)
        first = same.reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
        ok = first & (equal >= REGISTERS * (least - 0.45))
        i, j, a, b, equal = i[ok], j[ok], a[ok], b[ok], equal[ok]
        if not len(i):
            continue
        larger = (a > b).sum(1)
        e, possible = estimate(equal, larger, REGISTERS - equal - larger, n[i], n[j], least)
        if possible.any():
            yield i[possible], j[possible], e[possible]


def _name_partners(group: dict, band: int, least: float):
    """(a, b, estimate, whether there are others) of a tile: for each vertex its likeliest partner."""
    seen, best, partner = 0, np.full(len(group["n"]), -1.0), np.full(len(group["n"]), -1)
    for i, j, e in _possible(group, band, least):
        seen += len(i)
        ends, others, es = np.concatenate([i, j]), np.concatenate([j, i]), np.concatenate([e, e])
        order = np.lexsort((others, -es, ends))
        order = order[np.r_[True, np.diff(ends[order]) != 0]]
        order = order[es[order] > best[ends[order]]]
        best[ends[order]], partner[ends[order]] = es[order], others[order]
    if not seen:
        return None
    a = np.flatnonzero(partner >= 0)
    pairs, at = np.unique(np.sort(np.stack([a, partner[a]], 1), 1), axis=0, return_index=True)
    return pairs[:, 0], pairs[:, 1], best[a[at]], len(pairs) < seen


def _shared(own: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements each of ``others`` has in common with ``own``; all are sorted and distinct."""
    flat = np.concatenate(others)
    at = np.searchsorted(own, flat)
    hit = own[np.minimum(at, len(own) - 1)] == flat
    return np.add.reduceat(hit, np.r_[0, np.cumsum([len(o) for o in others])[:-1]], dtype=np.int64)


def _join_tile(group: dict, band: int, least: float, percent: int):
    """(a, b, estimate, False) of a tile: links, confirmed on the full sets, that join its components.

    Pairs within what the tile has already joined are passed over, so there are fewer links than
    components. Beside the sets themselves it holds one block of ``BLOCK`` elements, or one set.
    """
    values, offsets = group["elements"]
    values = values.view(np.uint64)
    n, comp = np.diff(offsets), group["comp"]
    root = np.arange(comp.max() + 1)
    out = []
    for i, j, e in _possible(group, band, least):
        cuts = np.flatnonzero(np.diff(i)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(i)], strict=True):
            x, ys, es = i[a], j[a:b], e[a:b]
            open_ = root[comp[ys]] != root[comp[x]]
            ys, es = ys[open_], es[open_]
            own = values[offsets[x] : offsets[x + 1]]
            at = 0
            while at < len(ys):
                upto = max(at + 1, int(np.searchsorted(np.cumsum(n[ys[at:]]), BLOCK)) + at)
                some = ys[at:upto]
                shared = _shared(own, [values[offsets[y] : offsets[y + 1]] for y in some])
                for k in np.flatnonzero(100 * shared >= percent * (n[x] + n[some] - shared)):
                    one, two = root[comp[x]], root[comp[some[k]]]
                    if one != two:
                        root[root == two] = one
                        out.append((x, some[k], es[at + k]))
                at = upto
    if not out:
        return None
    a, b, e = zip(*out, strict=True)
    return np.array(a), np.array(b), np.array(e), False


def _candidates(members: DataFrame, vertices: DataFrame, labels: DataFrame, sets: DataFrame | None, percent: int) -> DataFrame:
    """(a, b, ca, cb, e, more): without ``sets`` pairs named for confirming, with them confirmed links.

    ``labels`` (v, label) are the components so far. Without ``sets`` a large bucket is dealt over
    tiles and only pairs inside a tile are seen; with them every pair of a bucket meets in one tile.
    """
    import pyarrow as pa

    now = members.join(labels, "v", "left").withColumn("comp", F.coalesce("label", "v")).select("id", "band", "v", "n", "comp")
    per = now.groupBy("id", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("s"))
    buckets = per.groupBy("id").agg(F.sum("k").alias("size"), F.sum("s").alias("total"), F.max(F.struct("k", "comp", "s")).alias("top")).where("size > top.k")
    rows = now.join(buckets, "id").join(vertices.select("v", "registers"), "v")
    if sets is not None:
        rows = rows.join(sets, "v")
    least, carried = percent / 100, [] if sets is None else ["elements"]

    def tiled(k, n):
        return F.ceil(F.greatest(k / TILE, n / ELEMENTS)).cast("int")

    tiles = F.ceil(F.col("size") / TILE).cast("int") if sets is None else tiled(F.col("size"), F.col("total"))
    rows = rows.withColumn("c", tiles).withColumn("home", F.pmod(F.hash("v"), F.col("c")))
    if sets is None:
        dealt = rows.withColumn("t", F.struct(F.col("home").alias("i"), F.col("home").alias("j"), F.lit(True).alias("x"), F.lit(True).alias("y")))
    else:
        small = tiled(F.col("size") - F.col("top.k"), F.col("total") - F.col("top.s"))
        rows = rows.withColumn("cm", small).withColumn("minor", F.col("comp") != F.col("top.comp")).withColumn("xi", F.pmod(F.xxhash64("v"), F.col("cm")).cast("int"))
        dealt = rows.withColumn(
            "t",
            F.explode(
                F.expr(
                    "concat(transform(sequence(0, cm - 1), i -> struct(i as i, home as j, minor and i = xi as x, true as y)),"
                    " transform(filter(sequence(0, c - 1), j -> minor and j <> home), j -> struct(xi as i, j as j, true as x, false as y)))"
                )
            ),
        )
    dealt = dealt.select("id", "band", "v", "n", "registers", "comp", F.col("t.i").cast("int").alias("i"), F.col("t.j").cast("int").alias("j"), F.col("t.x").alias("is_x"), F.col("t.y").alias("is_y"), *carried)
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = dealt.repartition(parts, "id", "i", "j").sortWithinPartitions("id", "i", "j", "v")
    schema = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("ca", T.BinaryType()), T.StructField("cb", T.BinaryType()), T.StructField("e", T.DoubleType()), T.StructField("more", T.BooleanType())])

    def run(batches):
        def work(table):
            if len(table) < 2:
                return None
            cols = {k: table.column(k) for k in ("v", "n", "registers", "comp", "is_x", "is_y", *carried)}
            comp = cols["comp"].combine_chunks().dictionary_encode()
            group = {"registers": np.frombuffer(b"".join(cols["registers"].to_pylist()), "<u2").reshape(-1, REGISTERS), "n": cols["n"].to_numpy(), "comp": (comp.combine_chunks() if hasattr(comp, "combine_chunks") else comp).indices.to_numpy(), "is_x": cols["is_x"].to_numpy(zero_copy_only=False).astype(bool), "is_y": cols["is_y"].to_numpy(zero_copy_only=False).astype(bool)}
            band = table.column("band")[0].as_py()
            if carried:
                held = cols["elements"].combine_chunks()
                held = held.combine_chunks() if hasattr(held, "combine_chunks") else held
                group["elements"] = held.flatten().to_numpy(), np.r_[0, np.cumsum(held.value_lengths().to_numpy())]
                made = _join_tile(group, band, least, percent)
            else:
                made = _name_partners(group, band, least)
            if made is None:
                return None
            a, b, e, more = made
            v, c = cols["v"].combine_chunks(), cols["comp"].combine_chunks()
            return pa.RecordBatch.from_arrays([v.take(pa.array(a)), v.take(pa.array(b)), c.take(pa.array(a)), c.take(pa.array(b)), pa.array(e), pa.array(np.full(len(a), more))], names=schema.names)

        vacate()
        held = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in ("id", "i", "j")]
            cuts = np.flatnonzero((np.diff(key[0]) != 0) | (np.diff(key[1]) != 0) | (np.diff(key[2]) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                here = tuple(k[a] for k in key)
                if here != last:
                    if held and (out := work(pa.Table.from_batches(held))):
                        yield out
                    held, last = [], here
                held.append(batch.slice(a, b - a))
        if held and (out := work(pa.Table.from_batches(held))):
            yield out

    return ordered.mapInArrow(run, schema)


def group_near(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[Cut, DataFrame]:
    """(doc_id, h, v, n of every row, as a written table; v, label of every vertex that is linked with another)."""
    base = Cut(sketches(docs, size), "near-base")
    own_vertices = Cut(base.df.where("v is not null").groupBy("v").agg(F.first("n").alias("n"), F.first("registers").alias("registers"), F.min("h").alias("h")), "near-vertices")
    vertices = own_vertices.df
    crowded = bitmap(_bands(vertices, None).groupBy("id").agg(F.count("*").alias("k")).where("k >= 2"), "id")
    maybe = Cut(_bands(vertices, crowded), "near-bands")
    busy = maybe.df.groupBy("id").agg(F.count("*").alias("k")).where("k >= 2").select("id")
    own_members = Cut(maybe.df.join(busy, "id"), "near-members")
    members = own_members.df
    maybe.drop()
    labels = cut(members.select("v", F.col("v").alias("label")).distinct(), "near-labels")
    # one text of each vertex stands for it
    wanted = bitmap(labels.join(vertices.select("v", "h"), "v"), "h")
    own_sets = Cut(_full_sets(docs, size, wanted), "near-sets")
    sets = own_sets.df

    def joined(labels, links):
        """Components joined by links (a, b) between their labels."""
        found = components(links).select(F.col("v").alias("label"), F.col("label").alias("_new"))
        return cut(labels.join(found, "label", "left").select("v", F.coalesce("_new", "label").alias("label")), "near-labels")

    named = Cut(_candidates(members, vertices, labels, None, percent), "near-named")
    state = named.df.agg(F.count("*").alias("n"), F.max("more").alias("more")).first()
    crowds = members.groupBy("id").count().where(F.col("count") > TILE).limit(1).count()
    if state["n"]:
        pairs = named.df.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        one, two = sets.select(F.col("v").alias("a"), F.col("elements").alias("ea")), sets.select(F.col("v").alias("b"), F.col("elements").alias("eb"))
        both = F.size(F.array_intersect("ea", "eb"))
        labels = joined(labels, pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("ea") + F.size("eb") - both)).select("a", "b"))
    named.drop()
    if state["more"] or crowds:
        links = Cut(_candidates(members, vertices, labels, sets, percent).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "near-links")
        labels = joined(labels, links.df)
        links.drop(shuffles=False)
    for done in own_vertices, own_members:
        done.drop(shuffles=False)
    own_sets.drop()
    return base, labels


def _judged(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, Cut]:
    """The rows, and the table that they are made from."""
    base, labels = group_near(docs, size, percent)
    rows = base.df.select("doc_id", "h", "v", "n").join(labels, "v", "left").withColumn("c", F.coalesce("label", "v"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    least = rows.where("c is not null").groupBy("c").agg(F.min("doc_id").alias("component_id"), F.min(order).alias("first"))
    full = rows.join(least, "c", "left").withColumn("component_id", F.when(F.col("c").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return full.select("doc_id", "h", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("c").isNull() | (order == F.col("first"))).alias("first")), base


def with_components(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Null texts and texts without words have empty sets and are linked with nothing. The component of a
    row is its smallest id that isn't null; a row without id is kept only if no row of its component
    has one. Repeated rows are equal sets. Other columns are ignored; an empty table gives an empty
    result.
    """
    return _judged(docs.select("doc_id", "text"), size, percent)[0].drop("h", "first")


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component: that with its smallest id that isn't null, of these that with
    the least hash of its text; rows with empty sets stay.

    Of repeated rows one stays.
    """
    judged, base = _judged(docs.select("doc_id", "text"), size, percent)
    kept = cut(judged.where("first").groupBy("doc_id", "h").agg(F.count("*").alias("_rows")), "near-kept")
    base.drop()
    kept = kept.select(F.col("doc_id").alias("_kept_id"), F.col("h").alias("_kept_hash"), "_rows")
    found = docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")) & (F.xxhash64("text") == F.col("_kept_hash")))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = found.where("_rows = 1").select(*columns)
    if not kept.where("_rows > 1").limit(1).count():
        return found.select(*columns)
    return single.unionByName(found.where("_rows > 1").dropDuplicates(["_kept_id", "_kept_hash"]).select(*columns))
