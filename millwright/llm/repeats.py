"""Removal of repeated byte strings by bucket-pointer refinement.

A string of ``SPAN`` bytes that also starts anywhere else has all its bytes removed. Instead of sorting
the suffixes at all offsets, each window of ``SPAN`` bytes points to an anchor: the least q-gram (by
hash) in it. Equal windows have equal anchors at equal places, so the buckets of q-grams hold all
equal windows, and only anchors' buckets with two members or more matter. These are refined, each
round reusing the buckets of the last:

1. q-gram buckets: which anchors occur twice at all;
2. buckets of an anchor's full context (all windows that hold it): two equal contexts settle all
   windows of both anchors at once;
3. for the other anchors, buckets of runs of ``RUN`` neighbouring windows: what the windows have in
   common must occur twice, else none of them does; if their union does, all of them do;
4. for the runs that lie across the end of a repeat, buckets of single windows.

Each round is a scan of the texts that makes only the identifiers of what the rounds before left open,
and a count of equal identifiers, which is pre-aggregated. From the third round on, texts without an
anchor that occurs twice are passed over. What is open travels as a bitmap of at
most ``bitmaps.BITS`` bits: its false positives cost work and never change a result. No bucket is ever
gathered anywhere. Identifiers are 64-bit hashes, told apart further by the level's own bucket.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.batches import vacate
from millwright.llm.bitmaps import bitmap, has, packed, unpacked
from millwright.llm.rolling import Hashes, mix, sliding_min
from millwright.store import Cut, cut

SPAN, GRAM, RUN = 400, 64, 16
WIDTH = SPAN - GRAM + 1  # q-grams of a window
MAX_SEEN = 500_000  # settled contexts that a task remembers; beyond, they are made again
CHUNK = 4 << 20  # bytes of a text that are worked on together

_PLACES = np.arange(1 << 17, dtype=np.uint64)


class Open:
    """What the rounds so far left open, as bitmaps; None: nothing is known yet."""

    def __init__(self):
        self.grams = self.contexts = self.commons = self.edges = None
        self.texts = None  # by _hash

    def __getstate__(self):
        return {k: packed(v) for k, v in vars(self).items()}

    def __setstate__(self, state):
        vars(self).update({k: unpacked(v) for k, v in state.items()})


def chunks(data: np.ndarray):
    """(bytes, first window's place in them, number of windows, offset in the text, text length, own range).

    A chunk owns the anchors whose first window is in its own range. To see these whole it also holds
    the window before the range and the ``WIDTH`` windows behind it, so no anchor is cut at a border.
    """
    n = len(data)
    for at in range(0, max(0, n - SPAN + 1), CHUNK):
        low = max(0, at - SPAN)
        before = min(at, 1)
        windows = min(before + CHUNK + WIDTH, n - SPAN + 1 - at + before)
        yield data[low : at + windows + 2 * SPAN], at - before - low, windows, low, n, (before, before + CHUNK)


def scan(data: np.ndarray, level: str, known: Open, seen: set | None = None) -> dict[str, np.ndarray]:
    """The identifiers of one level of one text, as arrays of equal length.

    ``seen`` holds settled contexts that the task has been through: what they hold is made once, as it
    only needs to be known that it occurs.
    """
    parts = [_scan(*c, level, known, seen) for c in chunks(data)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]} if parts else {}


def _scan(b, first, windows, low, n, owned, level, known, seen):
    hashes = Hashes(b)
    grams = hashes.run(first, windows + WIDTH - 1, GRAM)
    placed = grams & ~np.uint64(0xFFFFFFFF)
    placed |= _PLACES[: len(grams)] if len(grams) <= len(_PLACES) else np.arange(len(grams), dtype=np.uint64)
    least = (sliding_min(placed, WIDTH) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    count = np.diff(np.concatenate([start, [windows]]))
    mine = (start >= owned[0]) & (start < owned[1])
    start, count = start[mine], count[mine]
    gram = grams[least[start]]
    anchor = least[start] + first
    start = start + first
    if level == "grams":
        return {"id": gram}
    keep = has(known.grams, gram)
    anchor, start, count, gram = anchor[keep], start[keep], count[keep], gram[keep]
    whole = (anchor + low >= WIDTH - 1) & (anchor + low + SPAN <= n)
    context = np.zeros(len(anchor), np.uint64)
    context[whole] = hashes.of(anchor[whole] - (WIDTH - 1), WIDTH - 1 + SPAN)
    if level == "contexts":
        return {"start": start + low, "count": count, "id": context, "whole": whole}
    own = ~whole | has(known.contexts, context)
    if seen is not None and not own.all():
        done = mix(context + (anchor - start).astype(np.uint64) * np.uint64(SPAN) + count.astype(np.uint64))
        new = own.copy()
        for i in np.flatnonzero(~own).tolist():
            x = int(done[i])
            if x not in seen:
                new[i] = True
                if len(seen) < MAX_SEEN:
                    seen.add(x)
        anchor, start, count, gram, own = anchor[new], start[new], count[new], gram[new], own[new]
    # runs of windows by their distance to the anchor
    far, near = anchor - start, anchor - start - count + 1
    n_runs = far // RUN - near // RUN + 1
    which = np.repeat(np.arange(len(anchor)), n_runs)
    run = near[which] // RUN + (np.arange(len(which)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs))
    far, near = np.minimum(far[which], run * RUN + RUN - 1), np.maximum(near[which], run * RUN)
    anchor, own, gram = anchor[which], own[which], gram[which]
    salt = mix(gram + run.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    common = hashes.of(anchor - run * RUN, SPAN - RUN + 1) ^ salt
    if level == "commons":
        return {"id": common, "own": own}
    keep = has(known.commons, common)
    anchor, own, run, far, near, common, salt = (x[keep] for x in (anchor, own, run, far, near, common, salt))
    left, right = anchor - run * RUN - RUN + 1, anchor - run * RUN + SPAN
    whole = (left + low >= 0) & (right + low <= n)
    union = np.zeros(len(anchor), np.uint64)
    union[whole] = hashes.of(left[whole], SPAN + RUN - 1) ^ salt[whole]
    if level == "unions":
        return {"start": anchor - far + low, "count": far - near + 1, "common": common, "id": union, "whole": whole, "own": own}
    keep = has(known.edges, common)
    anchor, own, far, near, salt = (x[keep] for x in (anchor, own, far, near, salt))
    size = far - near + 1
    which = np.repeat(np.arange(len(anchor)), size)
    window = (anchor - far)[which] + (np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size))
    return {"start": window + low, "id": hashes.of(window, SPAN) ^ salt[which], "own": own[which]}


COLUMNS = {
    "grams": ["id"],
    "contexts": ["start", "count", "id", "whole"],
    "commons": ["id", "own"],
    "unions": ["start", "count", "common", "id", "whole", "own"],
    "windows": ["start", "id", "own"],
}
KEY = ["_id", "_hash"]
_TYPES = {"id": T.LongType(), "common": T.LongType(), "start": T.LongType(), "count": T.LongType(), "whole": T.BooleanType(), "own": T.BooleanType()}


def level(docs: DataFrame, name: str, known: Open) -> DataFrame:
    """Rows of one level of all texts. From the third level on, rows that aren't ``own`` only count."""
    import pyarrow as pa

    columns = COLUMNS[name]
    keyed = "start" in columns
    schema = T.StructType([*([T.StructField(k, T.LongType()) for k in KEY] if keyed else []), *(T.StructField(c, _TYPES[c]) for c in columns)])
    shared = docs.sparkSession.sparkContext.broadcast(known)
    arrow = {"id": pa.int64(), "common": pa.int64(), "start": pa.int64(), "count": pa.int64(), "whole": pa.bool_(), "own": pa.bool_()}

    def run(batches):
        vacate()
        held, rows, seen = [], 0, set()

        def emit():
            made = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            arrays = [pa.array(made[c]) for c in KEY] if keyed else []
            for c in columns:
                x = made[c]
                arrays.append(pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, arrow[c]))
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            text = batch.column(batch.schema.get_field_index("text"))
            keys = [batch.column(batch.schema.get_field_index(k)).to_numpy() for k in KEY]
            for i in np.flatnonzero(has(shared.value.texts, keys[1].view(np.uint64))).tolist():
                data = text[i].as_buffer()
                if len(data) < SPAN:
                    continue
                made = scan(np.frombuffer(data, np.uint8), name, shared.value, seen)
                n = len(made["id"]) if made else 0
                if not n:
                    continue
                if keyed:
                    made |= {k: np.full(n, v[i], np.int64) for k, v in zip(KEY, keys, strict=True)}
                held.append(made)
                rows += n
                if rows > 100_000:
                    yield emit()
                    held, rows = [], 0
        if held:
            yield emit()

    return docs.mapInArrow(run, schema)


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(_id, _hash, text, ...): rows of one key hold equal texts, so that removal is the same for them."""
    text = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("_id"), F.xxhash64(text).alias("_hash"), text.alias("text"))


def repeated(ids: DataFrame, least: int = 2) -> DataFrame:
    return ids.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _spans(rows: DataFrame) -> DataFrame:
    return rows.select(*KEY, F.col("start").alias("from"), (F.col("start") + F.col("count") - 1 + SPAN).alias("to"))


def covered(texts: DataFrame) -> DataFrame:
    """(_id, _hash, spans): per text the byte ranges [from, to) that a repeated string covers, unmerged."""
    known = Open()
    known.grams = bitmap(repeated(level(texts, "grams", known)), "id")
    table = Cut(level(texts, "contexts", known), "repeat-contexts")
    contexts = table.df.where("whole").drop("whole")
    twice = Cut(repeated(contexts).select("id"), "repeat-twice")
    contexts_open = bitmap(contexts.join(twice.df, "id", "left_anti"), "id")
    settled = cut(_spans(contexts.join(twice.df, "id", "left_semi")), "repeat-settled")
    known.texts = bitmap(table.df, "_hash")  # the rest has no anchor that occurs twice
    twice.drop(shuffles=False)
    table.drop()
    known.contexts = contexts_open
    commons = level(texts, "commons", known).groupBy("id").agg(F.count("*").alias("n"), F.max("own").alias("own"))
    known.commons = bitmap(commons.where("n >= 2 and own"), "id")
    table = Cut(level(texts, "unions", known), "repeat-unions")
    unions = table.df
    twice = Cut(repeated(unions.where("whole")).select("id"), "repeat-twice")
    own = unions.where("own and whole")
    runs = cut(_spans(own.join(twice.df, "id", "left_semi")), "repeat-runs")
    left = own.join(twice.df, "id", "left_anti").select("common").unionByName(unions.where("own and not whole").select("common"))
    known.edges = bitmap(left, "common")
    twice.drop(shuffles=False)
    table.drop()
    table = Cut(level(texts, "windows", known), "repeat-windows")
    windows = table.df
    single = cut(_spans(windows.where("own").withColumn("count", F.lit(1)).join(repeated(windows).select("id"), "id", "left_semi")), "repeat-single")
    table.drop()
    spans = settled.unionByName(runs).unionByName(single).distinct()
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("from", "to")).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], b)
        else:
            out.append((a, b))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in spans:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _joined(docs: DataFrame, rest: list) -> DataFrame:
    texts = keyed(docs)
    own = docs.select(*rest, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_hash"), F.coalesce("text", F.lit("")).alias("_text"))
    return own.join(covered(texts), KEY, "left")


def removal_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document.

    Null texts are empty; texts of under ``SPAN`` bytes lose nothing; rows that repeat with their text
    are copies of each other; null ids are kept; other columns are ignored; an empty table gives an
    empty result.
    """
    import pyarrow as pa

    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])

    def run(batches):
        vacate()
        for batch in batches:
            ids, texts, spans = (batch.column(batch.schema.get_field_index(n)) for n in ("doc_id", "_text", "spans"))
            out = []
            for t, s in zip(texts, spans, strict=True):
                data, own = t.as_buffer().to_pybytes(), merged(s.as_py() or [])
                kept = without(data, own)
                out.append((len(data), len(data) - len(kept), len(own), hashlib.sha256(kept).hexdigest()))
            columns = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=schema.names)

    return _joined(docs.select("doc_id", "text"), ["doc_id"]).select("doc_id", "_text", "spans").mapInArrow(run, schema)


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated strings cut out of ``text`` (and ``n_chars``, if there, set to match).

    A character of which some bytes are removed goes whole.
    """
    import pyarrow as pa

    # the text travels once: out of the row, and back into it at the end
    light = docs.select("doc_id", "text", F.struct(*[F.lit(None).cast("string").alias(c) if c == "text" else F.col(c) for c in docs.columns]).alias("_row"))
    made = _joined(light, ["_row", "doc_id"]).select("_row", "_text", "spans")
    schema = T.StructType([*made.schema.fields[:2], T.StructField("_new", T.StringType())])

    def run(batches):
        vacate()
        for batch in batches:
            rows, texts, spans = (batch.column(batch.schema.get_field_index(n)) for n in ("_row", "_text", "spans"))
            new = [without(t.as_buffer().to_pybytes(), merged(s.as_py())).decode("utf-8", "ignore") if s.is_valid else None for t, s in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([rows, texts, pa.array(new, pa.string())], names=schema.names)

    done = made.mapInArrow(run, schema)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.coalesce("_new", "_text").alias(c))
        elif c == "n_chars":
            columns.append(F.when(F.col("_new").isNull(), F.col("_row.n_chars")).otherwise(F.length("_new")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"_row.`{c}`").alias(c))
    return done.select(*columns)
