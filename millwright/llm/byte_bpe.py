"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Pre-tokens never interact, so each distinct word of the corpus needs to be encoded once only:

1. Texts are cut into words, here the pattern's pre-tokens. (Runs between spaces are made distinct first,
   and each distinct run is cut into its pre-tokens; a run with characters that two libraries' tables
   might class differently stays whole, as one word of several pre-tokens.) A block of documents keeps
   its distinct words once, and for each document the positions: the words' numbers in the block, as
   variable-length bytes.
2. The blocks' words are shuffled by word. Here every distinct word meets itself from all blocks and is
   encoded once. A frequent word comes once from each block, never once from each place.
3. The ids go back to the blocks by block and word number, meet the positions there, and the
   documents' ids are put together by position.

Decoding looks every id up in the token-byte table, whose size the vocabulary bounds.
Words travel as one row for each block and shard of the words, not as one row each.
"""

import base64
import hashlib
import re
import unicodedata
import zlib
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.batches import pieces, resident
from millwright.store import cut

#: text bytes and distinct words from which a block is closed, and text bytes cut at a time
BLOCK_BYTES, BLOCK_WORDS, PIECE_BYTES = 64 << 20, 1 << 20, 24 << 20
MAX_WORDS = 1_000_000  # of one shard that are remembered; beyond, words are encoded again
#: a space with white space beside it, and the place before one that has none
BESIDE = re.compile(r" (?:\s|(?<=\s ))")
BORDER = re.compile(r"(?<=\S)(?= \S)")


def _encoding(ranks: str, pattern: str):
    return resident(("tiktoken", ranks, pattern), lambda: _load(ranks, pattern))


def _load(ranks: str, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks, "rb"))}
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    tokens = [b""] * (max(table.values()) + 1)
    for token, rank in table.items():
        tokens[rank] = token
    return encoding, tokens


def words(text: str) -> list[str]:
    """Runs whose concatenation is the text; pre-tokens never span two of them.

    A space between two characters that are no white space is the start of the next run. Around other
    white space, whose tokens depend on what follows them, nothing is cut.
    """
    if BESIDE.search(text):
        return [w for w in BORDER.split(text) if w]
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + w for w in rest]


#: characters that may be classed otherwise by another table
OTHER = re.compile("[^\n\t -~À-ÖØ-öø-ÿ]")


class _Stable(dict):
    """Whether a character has had the same category from Unicode 3.2 on, and is no doubtful white space."""

    def __missing__(self, c: str) -> bool:
        made = self[c] = unicodedata.ucd_3_2_0.category(c) == unicodedata.category(c) != "Cn" and not "\x1c" <= c <= "\x1f" and c not in "\x85\u180e\u200b"
        return made


_stable = _Stable()


def pre_tokens(runs: list[str], pattern) -> tuple[list[str], np.ndarray]:
    """The pre-tokens of all runs in order, and how many each has. Where their borders may be in doubt,
    the run itself is the only one.

    The runs' texts are cut as one: no pre-token spans two of them. The first one need not start with a
    space, as the others do.
    """
    joined = "".join(runs)
    ends = np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))
    doubtful = [m.start() for m in OTHER.finditer(joined) if not _stable[m[0]]]
    # a lone space would join the white space before it
    whole = np.unique(np.r_[np.searchsorted(ends, doubtful, "right"), [k for k, r in enumerate(runs) if r == " "]].astype(np.int64))
    if len(whole):
        parts, sizes, at = [], np.ones(len(runs), np.int64), 0
        for k in [*whole.tolist(), len(runs)]:
            if k > at:
                found, sizes[at:k] = pre_tokens(runs[at:k], pattern)
                parts += found
            parts += runs[k : k + 1]
            at = k + 1
        return parts, sizes
    found = pattern.findall(joined)
    places = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    at = np.searchsorted(places, ends) + 1
    if len(found) and (places[-1] != ends[-1] or (places[at - 1] != ends).any()):
        raise ValueError("the pattern's matches span two runs, or leave something out")
    return found, np.diff(np.r_[0, at]) if len(found) else np.zeros(len(runs), np.int64)


class _Cutter:
    """Numbers of the words of texts, in the order in which a block meets its distinct words."""

    def __init__(self, pattern):
        self.pattern, self.number = pattern, {}

    def _numbers(self, flat: list[str]) -> np.ndarray:
        import pyarrow as pa

        if not flat:
            return np.zeros(0, np.int64)
        coded = pa.array(flat, pa.string()).dictionary_encode()
        number = self.number
        return np.array([number.setdefault(w, len(number)) for w in coded.dictionary.to_pylist()], np.int64)[coded.indices.to_numpy()]

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        import pyarrow as pa
        import pyarrow.compute as pc

        out: list = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if BESIDE.search(t):
                out[i] = self._numbers(pre_tokens(words(t), self.pattern)[0])
            else:
                plain.append(i)
        split = pc.split_pattern(pa.array([texts[i] for i in plain], pa.string()), " ")
        coded = split.flatten().dictionary_encode()
        at, distinct = split.offsets.to_numpy(), coded.dictionary.to_pylist()
        run = coded.indices.to_numpy().astype(np.int64)
        # a text's first run has no space before it
        first = list(dict.fromkeys(run[at[:-1]].tolist()))
        place = np.zeros(len(distinct), np.int64)
        place[first] = len(distinct) + np.arange(len(first))
        run[at[:-1]] = place[run[at[:-1]]]
        # what starts with white space is a text's first run only
        found, size = pre_tokens([" " if w[:1].isspace() else " " + w for w in distinct], self.pattern)
        alone = [pre_tokens([distinct[k]], self.pattern)[0] if distinct[k] else [] for k in first]
        flat, size = self._numbers([*found, *chain.from_iterable(alone)]), np.r_[size, [len(x) for x in alone]].astype(np.int64)
        starts, n = np.cumsum(size) - size, size[run]
        ends = np.cumsum(n)
        numbers = flat[np.repeat(starts[run] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        cuts = np.r_[0, ends][at].tolist()
        for k, i in enumerate(plain):
            out[i] = numbers[cuts[k] : cuts[k + 1]].astype(np.int32)
        return out


def pack_numbers(x: np.ndarray) -> bytes:
    """Numbers below 2**28 in 1 to 4 bytes of 7 bits each, the last one with the high bit."""
    x = x.astype(np.uint32)
    size = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(4):
        on = size > k
        byte = ((x[on] >> np.uint32(7 * k)) & np.uint32(127)).astype(np.uint8)
        last = size[on] == k + 1
        out[ends[on] - size[on] + k] = byte | (last.astype(np.uint8) << 7)
    return out.tobytes()


def unpack_numbers(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(b & 128)
    starts = np.concatenate([[0], ends[:-1] + 1])
    place = np.arange(len(b)) - np.repeat(starts, ends - starts + 1)
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * place), starts)


def occurrences(held: list[np.ndarray], n: int) -> np.ndarray:
    """How often each of ``n`` numbers occurs in all arrays, in work that follows their lengths: some ``n`` places are
    counted at a time, as a count costs ``n`` however few there are."""
    often = np.zeros(n, np.int64)
    some, places = [], 0
    for numbers in held:
        some.append(numbers)
        places += len(numbers)
        if places >= n:
            often += np.bincount(np.concatenate(some), minlength=n)
            some, places = [], 0
    return often + np.bincount(np.concatenate(some), minlength=n) if some else often


BLOCKS = T.StructType(
    [
        T.StructField("block", T.LongType()),
        T.StructField("shard", T.IntegerType()),  # of the words; null in a document's row
        T.StructField("words", T.ArrayType(T.StringType())),
        T.StructField("doc_id", T.LongType()),
        T.StructField("check", T.LongType()),  # of the block's distinct words and their numbers
        T.StructField("places", T.BinaryType()),
    ]
)


def _blocks(docs: DataFrame, shards: int, pattern: str, kinds: str = "words documents") -> DataFrame:
    """Rows of both kinds, or of one. A word's number in its block follows from (shard, number in the shard)."""
    import pyarrow as pa

    types = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.binary())

    def rows_of(name, ids, held, distinct):
        block = name.intdigest() - (1 << 63)
        often = occurrences(held, len(distinct))
        by_count = np.argsort(-often, kind="stable")  # positions use small numbers for frequent words
        new = np.empty(len(distinct), np.int64)
        new[by_count] = np.arange(len(distinct))
        check = zlib.crc32("\0".join(distinct[i] for i in by_count).encode("utf-8", "surrogatepass"))
        if "words" in kinds:
            shard = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % shards for w in distinct), np.int64, len(distinct))
            by_shard, sizes, at = np.argsort(shard, kind="stable"), np.bincount(shard, minlength=shards), 0
            for s in np.flatnonzero(sizes):
                own = by_shard[at : at + sizes[s]]
                at += sizes[s]
                yield block, int(s), [distinct[i] for i in own], None, check, pack_numbers(new[own])
        if "documents" in kinds:
            for doc_id, numbers in zip(ids, held, strict=True):
                yield block, None, None, doc_id, check, pack_numbers(new[numbers])

    def run(batches):
        import regex
        import xxhash

        compiled = regex.compile(pattern)

        def close():
            rows = rows_of(name, ids, held, list(cut_texts.number))
            while some := list(islice(rows, 2000)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names=BLOCKS.names)

        def fresh():
            return _Cutter(compiled), xxhash.xxh3_64(), [], [], 0

        cut_texts, name, ids, held, size = fresh()
        for batch in batches:
            column, own_ids = (batch.column(batch.schema.get_field_index(n)) for n in ("text", "doc_id"))
            for a, b in pieces(column, PIECE_BYTES):
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                here = own_ids.slice(a, b - a).to_pylist()
                # a block is named by its content: the same when it is made again, in whatever task
                name.update(repr(here).encode())
                for t in texts:
                    name.update(t.encode("utf-8", "surrogatepass"))
                ids += here
                held += cut_texts(texts)
                size += sum(map(len, texts))
                if size >= BLOCK_BYTES or len(cut_texts.number) >= BLOCK_WORDS:
                    yield from close()
                    cut_texts, name, ids, held, size = fresh()
        if ids:
            yield from close()

    return docs.mapInArrow(run, BLOCKS)


def encode(docs: DataFrame, ranks: str, pattern: str, finish, fields: list[T.StructField], stable: bool = False) -> DataFrame:
    """doc_id and what ``finish(ids, tokens)`` makes of each document's ids and the token-byte table.

    Null texts are empty and have no ids; ids may be null or repeat; other columns are ignored.
    The blocks are read twice. ``stable`` says that ``docs`` gives the same rows in the same order each
    time, as a scan of files does; then they are made twice, else written to the shared folder. A block
    that came out differently fails the job.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if stable:
        given, places = _blocks(own, 4 * parts, pattern, "words"), _blocks(own, 4 * parts, pattern, "documents")
    else:
        given = places = cut(_blocks(own, 4 * parts, pattern), "bpe-blocks")
    meet = T.StructType([T.StructField("block", T.LongType()), T.StructField("check", T.LongType()), T.StructField("doc_id", T.LongType()), T.StructField("places", T.BinaryType()), T.StructField("ids", T.BinaryType()), T.StructField("sizes", T.BinaryType()), T.StructField("is_doc", T.BooleanType())])

    def once(batches):
        """Words of a shard to ids; every distinct word is encoded when first met, and forgotten after its shard."""
        encoding, _ = _encoding(ranks, pattern)
        known: dict[str, list[int]] = {}
        shard = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["shard"] != shard or len(known) > MAX_WORDS:
                    known, shard = {}, row["shard"]
                fresh = [w for w in row["words"] if w not in known]
                for w, ids in zip(fresh, map(encoding.encode_ordinary, fresh), strict=True):
                    known[w] = ids
                own = list(map(known.__getitem__, row["words"]))
                sizes = np.fromiter(map(len, own), np.int64, len(own))
                ids = np.fromiter((i for x in own for i in x), np.int64, int(sizes.sum()))
                out.append((row["block"], row["check"], None, row["places"], pack_numbers(ids), pack_numbers(sizes), False))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=meet.names)

    types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
    encoded = given.where("shard is not null").select("block", "check", "shard", "words", "places").repartition(parts, "shard").sortWithinPartitions("shard").mapInArrow(once, meet)
    documents = places.where("shard is null").select("block", "check", "doc_id", "places", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("sizes"), F.lit(True).alias("is_doc"))
    together = encoded.unionByName(documents).repartition(parts, "block").sortWithinPartitions("block", "is_doc")
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *fields])

    def assemble(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        _, tokens = _encoding(ranks, pattern)
        block, dictionary, table = None, [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["block"] != block:
                    block, dictionary, table = row["block"], [], None
                if not row["is_doc"]:
                    dictionary.append((unpack_numbers(row["places"]), unpack_numbers(row["sizes"]) if row["sizes"] else np.zeros(0, np.int64), unpack_numbers(row["ids"]), row["check"]))
                    continue
                if table is None:
                    numbers = np.concatenate([d[0] for d in dictionary] or [np.zeros(0, np.int64)])
                    sizes = np.concatenate([d[1] for d in dictionary] or [np.zeros(0, np.int64)])
                    flat = np.concatenate([d[2] for d in dictionary] or [np.zeros(0, np.int64)])
                    if not dictionary and row["places"] or any(d[3] != row["check"] for d in dictionary):
                        raise RuntimeError("a block's words were cut differently when they were read again")
                    starts = np.empty(len(numbers), np.int64)
                    length = np.empty(len(numbers), np.int64)
                    starts[numbers], length[numbers] = np.cumsum(sizes) - sizes, sizes
                    table, dictionary = (starts, length, flat), []
                starts, length, flat = table
                at = unpack_numbers(row["places"])
                n = length[at]
                ends = np.cumsum(n)
                ids = flat[np.repeat(starts[at] - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
                out.append((row["doc_id"], *finish(ids, tokens)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], names=schema.names)

    return together.mapInArrow(assemble, schema)


def decode(ids: np.ndarray, tokens: list[bytes]) -> bytes:
    """The bytes of ids: each id's bytes from the table, joined."""
    return b"".join(map(tokens.__getitem__, ids.tolist()))


def encode_decode(docs: DataFrame, ranks: str, pattern: str, stable: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""

    def finish(ids, tokens):
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decode(ids, tokens)).hexdigest()

    return encode(docs, ranks, pattern, finish, [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())], stable)


def ids_of(docs: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """doc_id and the ids themselves."""
    return encode(docs, ranks, pattern, lambda ids, _: (ids.tolist(),), [T.StructField("ids", T.ArrayType(T.IntegerType()))])
