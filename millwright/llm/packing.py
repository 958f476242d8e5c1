"""Best-fit packing of token sequences by minimum bin slack.

Documents are tokenized and cut into pieces of at most ``capacity`` tokens. Only the histogram of piece
lengths (``capacity`` rows at most, whatever the corpus) reaches the driver. There each bin takes the
longest length left, and a bitset subset-sum dynamic program over the other lengths available finds
the combination that leaves the least slack; it is applied as often as the counts allow, and removed.
The outcome is a table of slots by length, so that every piece finds its sequence from its rank among
the pieces of its length. Ranks come from counts by partition, not from one sorted group.
"""

import os
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from millwright.llm.batches import pieces, resident, vacate
from millwright.store import cut

CAPACITY = 2048
END_ID = 0
MAX_WORDS = 600_000  # words and pre-tokens that a worker keeps; a matter of memory, not of results
BATCH_BYTES = 2 << 20


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to ``room``: length -> how often.

    Bit s of ``reach`` says that the sum s can be made. Longer lengths come first, so that of equal
    sums the one with fewer, longer pieces tends to be found.
    """
    steps, reach, mask = [], 1, (1 << (room + 1)) - 1
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, chunk = min(counts[length], room // length), 1
        while left:
            n = min(chunk, left)
            steps.append((length, n, reach))
            reach |= (reach << length * n) & mask
            left -= n
            chunk *= 2
        if reach >> room & 1:
            break
    total, out = reach.bit_length() - 1, {}
    for length, n, before in reversed(steps):
        if not before >> total & 1:
            total -= length * n
            out[length] = out.get(length, 0) + n
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(bins, length -> how often in each of them), until no piece is left."""
    counts = {k: n for k, n in histogram.items() if n}
    out = []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        content = fullest(counts, capacity - longest)
        counts[longest] += 1
        content[longest] = content.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in content.items())
        for k, n in content.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        out.append((times, content))
    return out


class Slots:
    """Where the pieces of each length go, by their rank."""

    def __init__(self, planned: list[tuple[int, dict[int, int]]], capacity: int):
        rows, taken, bins = [], [0] * (capacity + 1), 0
        for times, content in planned:
            offset = 0
            for length in sorted(content, reverse=True):
                n = content[length]
                rows.append((length, taken[length], bins, n, offset))
                taken[length] += n * times
                offset += n * length
            bins += times
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.bins = bins
        self.before = np.concatenate([[0], np.cumsum(taken)]).astype(np.int64)  # pieces of shorter lengths
        self.length, self.start, self.bin, self.n, self.offset = table.T.copy()
        self.key = self.before[self.length] + self.start

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of pieces."""
        at = np.searchsorted(self.key, self.before[length] + rank, "right") - 1
        step = rank - self.start[at]
        return self.bin[at] + step // self.n[at], self.offset[at] + step % self.n[at] * length


#: words of these characters alone, and without "<|", are pre-tokenized here; all others by the library
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: the vocabulary's pre-tokens inside such a word, lower-cased
UNITS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zßà-öø-ÿ]+|[0-9]|[^a-zßà-öø-ÿ0-9]+")
JOINED = 400  # units that the library gets as one text


class Encoder:
    """Ids of whole texts as little-endian 32-bit integers.

    The vocabulary's tokens never span a space or a line break, and each pre-token ends with an
    end-of-word token. So texts become dictionary codes of the distinct words between spaces, each
    distinct pre-token is encoded once and kept, and one ``take`` of the words' ids makes the texts'.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[str]) -> None:
        """Encodes units, each one pre-token, many in one text; they part after the end-of-word tokens."""
        groups = [units[i : i + JOINED] for i in range(0, len(units), JOINED)]
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups]), strict=True):
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(group) or ends[-1] != len(ids):
                parts = self._encode(group)
                self.known.update((u, p.tobytes()) for u, p in zip(group, parts, strict=True))
                continue
            data, at = ids.tobytes(), 0
            for unit, end in zip(group, (4 * ends).tolist(), strict=True):
                self.known[unit] = data[at:end]
                at = end

    def words(self, distinct: list[str]) -> list[bytes]:
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        known = self.known
        fresh = [w for w in distinct if w not in known]
        plain = [w for w in fresh if PLAIN.fullmatch(w) and "<|" not in w]
        split = [UNITS.findall(w.lower()) for w in plain]
        self._learn(list({u for us in split for u in us}.difference(known)))
        for w, us in zip(plain, split, strict=True):
            if w not in known:
                known[w] = b"".join(map(known.__getitem__, us))
        other = [w for w in fresh if w not in known]
        for w, ids in zip(other, self._encode(other), strict=True):
            known[w] = ids.tobytes()
        return list(map(known.__getitem__, distinct))

    def __call__(self, texts) -> list[bytes]:
        """Of an Arrow array of strings without nulls, small enough for 32-bit offsets."""
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        made = pa.array(self.words(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(made.buffers()[1], np.int64)[: len(made) + 1] if len(made) else np.zeros(1, np.int64)
        at = ends[split.offsets.to_numpy()].tolist()
        data = memoryview(made.buffers()[2] or b"")
        return [bytes(data[x:y]) for x, y in zip(at, at[1:], strict=False)]


def tokenize(docs: DataFrame, tokenizer: str, capacity: int, row: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, _part, _rank) of every piece; with ``row``, that column too."""
    import pyarrow as pa

    extra = [docs.schema[row]] if row else []
    schema = T.StructType([*extra, docs.schema["doc_id"], T.StructField("piece", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("start", "length", "ids_crc32")), T.StructField("_part", T.IntegerType()), T.StructField("_rank", T.LongType())])

    def run(batches):
        from pyspark import TaskContext

        encode = resident(("encoder", tokenizer), lambda: Encoder(tokenizer))
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.asarray([END_ID], "<u4").tobytes()
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text")).fill_null("")
            for a, b in pieces(column, BATCH_BYTES):
                out = {k: [] for k in ("at", "piece", "start", "length", "crc", "rank")}
                for i, ids in enumerate(encode(column.slice(a, b - a))):
                    ids += end
                    for k, start in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[start : start + 4 * capacity]
                        n = len(own) // 4
                        for name, value in zip(out, (i + a, k, start // 4, n, zlib.crc32(own), seen[n]), strict=True):
                            out[name].append(value)
                        seen[n] += 1
                at = pa.array(out["at"], pa.int64())
                carried = [batch.column(batch.schema.get_field_index(n)).take(at) for n in ([row] if row else []) + ["doc_id"]]
                made = [pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "crc")), pa.array([part] * len(at), pa.int32()), pa.array(out["rank"], pa.int64())]
                yield pa.RecordBatch.from_arrays(carried + made, names=schema.names)
            pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document.

    A null or empty text is the closing id alone. Null and repeated ids are packed as rows of their own;
    other columns are ignored; an empty table gives an empty result.
    """
    import pyarrow as pa

    table = cut(tokenize(docs.select("doc_id", "text"), tokenizer, capacity), "pieces")
    counts = table.groupBy("_part", "length").count()
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    slots = table.sparkSession.sparkContext.broadcast(Slots(plan(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    ranked = table.join(offsets, ["_part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
    schema = T.StructType([*ranked.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        vacate()
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("length", "_rank"))
            found = slots.value.find(length, rank) if len(length) else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(x, pa.int64()) for x in found)], names=schema.names)

    return ranked.mapInArrow(place, schema)
