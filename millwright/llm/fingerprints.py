"""Document fingerprints: a Merkle tree over paragraphs and sections.

A text is split into sections at blank lines and those into paragraphs at line breaks; every character
belongs to one paragraph. A paragraph's node is the hash of its bytes, a section's the hash of its
paragraphs' nodes, the root the hash of the sections' nodes: roots test equality, differing branches
locate edits. Each paragraph also carries a row of short leaf marks, one for each run of a few words
cut where the content says so, so that edits inside a paragraph are located and likeness is fine
grained. The fingerprint is the tree as text:

    root:section,paragraph=marks,paragraph=marks;section,...
"""

import base64
import hashlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.rolling import BYTE, powers

CONTEXT = 16
SIZE = 8  # bytes of an inner node; the root has 16


def leaf_marks(data: bytes) -> bytes:
    """3 bytes for each leaf of a paragraph. A leaf ends after a space if its last bytes say so (1 in 4);
    its mark also covers the ``CONTEXT`` bytes before it, so that single common words don't match."""
    b = np.frombuffer(data, np.uint8)
    n = len(b)
    if not n:
        return b""
    up, down = powers(n + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[b] * up[:n])])
    spaces = np.flatnonzero(b == 32)
    since = np.maximum(spaces - 8, 0)
    mix = (total[spaces] - total[since]) * down[since] * np.uint64(0xBF58476D1CE4E5B9)
    ends = spaces[mix >> np.uint64(62) == 0] + 1
    cuts = np.concatenate([[0], ends[ends < n], [n]])
    first = np.maximum(cuts[:-1] - CONTEXT, 0)
    h = (total[cuts[1:]] - total[first]) * down[first]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _hash(data: bytes, size: int = SIZE) -> bytes:
    return hashlib.blake2b(data, digest_size=size).digest()


def sections(text: str) -> list[list[str]]:
    """Paragraphs with their line ends, grouped; a blank line ends a group and belongs to it."""
    out: list[list[str]] = [[]]
    for line in text.split("\n"):
        if out[-1] and not line.strip() and out[-1][-1].strip():
            out[-1].append(line)
            out.append([])
        else:
            out[-1].append(line)
    return [s for s in out if s]


def fingerprint(text: str) -> str:
    """The Merkle tree of a whole text. An empty text is one empty paragraph."""
    made, nodes = [], []
    for own in sections(text):
        leaves, hashes = [], []
        for p in own:
            data = p.encode("utf-8", "surrogatepass")
            h = _hash(data)
            hashes.append(h)
            leaves.append(h.hex() + "=" + base64.b64encode(leaf_marks(data)).decode())
        node = _hash(b"s" + b"".join(hashes))
        nodes.append(node)
        made.append(node.hex() + "," + ",".join(leaves))
    return _hash(b"r" + b"".join(nodes), 16).hex() + ":" + ";".join(made)


def tree(print_: str) -> tuple[str, list[tuple[str, list[tuple[str, str]]]]]:
    """(root, [(section, [(paragraph, marks)])])."""
    root, _, rest = print_.partition(":")
    out = []
    for s in rest.split(";"):
        node, *own = s.split(",")
        out.append((node, [tuple(p.split("=", 1)) for p in own]))
    return root, out


def differing(a: str, b: str) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(section, paragraph) of the paragraphs of either tree that the other lacks: where the edits are."""
    (ra, sa), (rb, sb) = tree(a), tree(b)
    if ra == rb:
        return [], []

    def lacking(own, other):
        branches = {n for n, _ in other}
        there = {p for _, ps in other for p, _ in ps}
        return [(i, j) for i, (n, ps) in enumerate(own) if n not in branches for j, (p, _) in enumerate(ps) if p not in there]

    return lacking(sa, sb), lacking(sb, sa)


def likeness(a: str, b: str) -> float:
    """Shared leaves over the leaves of the larger tree, 0 to 1. Equal branches are matched whole."""
    (ra, sa), (rb, sb) = tree(a), tree(b)
    if ra == rb:
        return 1.0
    size = lambda marks: len(marks) // 4  # noqa: E731  blank lines count nothing
    pa, pb = ([p for _, ps in s for p in ps] for s in (sa, sb))
    most = max(1, sum(size(m) for _, m in pa), sum(size(m) for _, m in pb))
    ca, cb = Counter(pa), Counter(pb)
    both = ca & cb
    shared = sum(n * size(m) for (_, m), n in both.items())
    la, lb = (Counter(x for (_, m), n in (c - both).items() for x in [m[i : i + 4] for i in range(0, len(m), 4)] * n) for c in (ca, cb))
    shared += sum((la & lb).values())
    return min(1.0 - 1e-9, shared / most)


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many first characters (or all) of ``following``."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and likenesses.

    The next document is the one with the next larger id, of equal ids the one with the larger text;
    after the last comes the first. Null ids sort first; null texts are empty; repeated rows follow one
    another; other columns are ignored; an empty table gives an empty result, a single document follows
    itself.

    Ids are cut into ranges at quantiles of their distribution; each range also gets a copy of the
    first row of the next range, so that one shuffle of the texts by range gives every row its
    follower. To the driver go only the ranges' borders and first rows' ids.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    low = -(1 << 63)
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(low))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    borders = sorted({int(x) for x in rows.select(key.cast("double").alias("k")).approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts)})
    bucket = F.lit(0)
    if borders:
        bucket = F.expr("size(filter(array({}), b -> b <= k))".format(",".join(f"{b}L" for b in borders)))
    placed = rows.withColumn("k", key).withColumn("bucket", bucket)
    # first id of each non-empty range
    firsts = sorted((int(r["bucket"]), int(r["k"])) for r in placed.groupBy("bucket").agg(F.min("k").alias("k")).collect())
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_chars", T.LongType()), *(T.StructField(n, T.StringType()) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")), *(T.StructField(n, T.DoubleType()) for n in ("near_edited", "near_next"))])
    before = {firsts[i][0]: firsts[i - 1][0] for i in range(len(firsts))}
    ghost_of = F.create_map(*[F.lit(x) for b, k in firsts for x in (f"{b}/{k}", before[b])]) if firsts else None
    if firsts:
        target = F.element_at(ghost_of, F.concat_ws("/", F.col("bucket").cast("string"), F.col("k").cast("string")))
        own = F.struct(F.col("bucket"), F.lit(False).alias("ghost"))
        spread = placed.withColumn("_to", F.when(target.isNotNull(), F.array(own, F.struct(target.alias("bucket"), F.lit(True).alias("ghost")))).otherwise(F.array(own)))
        placed = spread.select("doc_id", "text", "k", F.explode("_to").alias("_to")).select("doc_id", "text", "k", "_to.*")
    else:
        placed = placed.withColumn("ghost", F.lit(False))
    dealt = placed.repartitionById(max(1, len(borders) + 1), F.col("bucket").cast("int")).sortWithinPartitions("bucket", "ghost", "k", "text")

    def run(batches):
        def emit(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], names=schema.names)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        held, out, size = None, [], 0  # held: the row that waits for its follower
        for batch in batches:
            for i in range(batch.num_rows):
                doc, text, b, ghost = (batch.column(batch.schema.get_field_index(n))[i].as_py() for n in ("doc_id", "text", "bucket", "ghost"))
                if ghost and (held is None or held[2] != b):
                    continue  # a second copy of the follower: its rows have equal ids
                print_ = fingerprint(text)
                if held is not None and held[2] == b:
                    new = edited(held[1], text)
                    other = fingerprint(new)
                    out.append((held[0], len(held[1]), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), held[3], other, likeness(held[3], other), likeness(held[3], print_)))
                    size += len(held[3]) + len(other)
                    if size > 1 << 22:
                        yield from emit(out)
                        out, size = [], 0
                held = None if ghost else (doc, text, b, print_)
        if out:
            yield from emit(out)

    return dealt.mapInArrow(run, schema)
