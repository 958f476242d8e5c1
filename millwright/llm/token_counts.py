"""Token counts by a finite-state transducer compiled from a piece vocabulary.

The pieces of a BPE model with byte fallback are compiled, state by state on demand, into a
deterministic transducer. After any prefix of a word its encoding ends with one definite token, so a
state holds the longest end of the prefix that may still grow into a piece and, for each place in
that end, the token that ends there and the tokens counted up to it, relative to now. A transition
reads one character and is annotated with the change of the token count. The states don't depend on
what stands before that end, so they are few. A text is cut into chunks, each reduced to a state map

    Open(s)            no word starts inside: all of it belongs to a word begun earlier
    Closed(h, n, t)    h ends the word begun earlier, n tokens lie between, t is the last word so far

and the maps compose associatively, so that the chunks of a very long text are counted in different
tasks and joined by a parallel prefix scan (here an ordered reduction per document).
"""

import re
from functools import lru_cache, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.batches import map_texts

SPACE = "▁"
#: Characters of a chunk, and of a text from which its chunks are spread over tasks.
CHUNK, SPREAD = 1 << 16, 1 << 20
#: States and words that one Python worker keeps at most before it starts afresh.
MAX_STATES, MAX_WORDS = 400_000, 600_000


class Transducer:
    """Counts the tokens that the BPE vocabulary ``scores`` (piece -> score) gives for words."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        if any(SPACE in p.lstrip(SPACE) for p in scores):
            raise ValueError("a piece spans the start of a word; words can't be counted apart")
        #: a text end that is one of these may still grow into a piece
        self.prefixes = {p[:k] for p in scores for k in range(1, len(p))}
        self.whole: dict[str, bool] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.words: dict[str, int] = {}
        self.restart()

    def restart(self) -> None:
        start = ("", ((None, 0),))
        self.ids, self.keys, self.next = {start: 0}, [start], [{}]

    def merge(self, text: str) -> list[str]:
        """Tokens of ``text``: the best-scored pair is merged again and again, the leftmost on ties."""
        parts, get = list(text), self.scores.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def reached(self, piece: str) -> bool:
        """Whether merging the characters of ``piece`` ever makes it."""
        if piece not in self.whole:
            self.whole[piece] = piece in self.scores and self.merge(piece) == [piece]
        return self.whole[piece]

    def fits(self, left: str, right: str) -> bool:
        """Whether the encoding of both texts together keeps these two tokens apart."""
        pair = left, right
        if pair not in self.pairs:
            self.pairs[pair] = self.merge(left + right) == [left, right]
        return self.pairs[pair]

    def step(self, state: int, char: str) -> tuple[int, int]:
        end, places = self.keys[state]
        for j, (token, count) in enumerate(places):
            new = end[j:] + char
            if token != "" and (j == len(end) and new not in self.scores or self.reached(new) and (token is None or self.fits(token, new))):
                break
        else:
            raise AssertionError("no token can end here")
        weight = 1 if new in self.scores else len(char.encode("utf-8", "surrogatepass"))
        change = count + weight
        end, places = end + char, [*((t, n - change) for t, n in places), (new, 0)]
        while end and end not in self.prefixes:
            end, places = end[1:], places[1:]
        # a place from which no piece can reach the next character is never asked again
        key = end, tuple(p if not end[j:] or end[j:] in self.prefixes else ("", 0) for j, p in enumerate(places))
        there = self.ids.get(key)
        if there is None:
            there = self.ids[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        made = self.next[state][char] = there, change
        return made

    def word(self, text: str) -> int:
        """Tokens of one word: a run of spaces, then other characters."""
        known = self.words.get(text)
        if known is not None:
            return known
        if len(self.keys) > MAX_STATES:
            self.restart()
        if len(self.pairs) > MAX_STATES:
            self.pairs = {}
        if len(self.words) > MAX_WORDS:
            self.words = {}
        state, total, states = 0, 0, self.next
        for c in text:
            made = states[state].get(c)
            if made is None:
                made = self.step(state, c)
            state = made[0]
            total += made[1]
        self.words[text] = total
        return total


@lru_cache(maxsize=2)
def compiled(model: str) -> Transducer:
    """The transducer of a sentencepiece BPE model; a Python worker keeps it for its later tasks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    return Transducer({sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))})


WORD = re.compile(f"{SPACE}+[^{SPACE}]*")

#: head, whether a word starts inside, tokens between, last word
Map = tuple[str, bool, int, str]
EMPTY: Map = ("", False, 0, "")


def state_map(machine: Transducer, chunk: str) -> Map:
    """The state map of one chunk. Its last word may go on in the next chunk."""
    chunk = chunk.replace(" ", SPACE)
    at = chunk.find(SPACE)
    if at < 0:
        return chunk, False, 0, ""
    words = WORD.findall(chunk, at)
    return chunk[:at], True, sum(map(machine.word, words[:-1])), words[-1]


def compose(machine: Transducer, a: Map, b: Map) -> Map:
    """The state map of two neighbouring chunks; associative, with ``EMPTY`` as neutral element."""
    if not a[1]:
        return a[0] + b[0], b[1], b[2], b[3]
    if not b[1]:
        return a[0], True, a[2], a[3] + b[0]
    if b[3] and not b[0] and not a[3].strip(SPACE):
        # spaces on both sides of the border are one run, which starts one word
        if b[2] or b[3].strip(SPACE):
            raise ValueError("cut chunks so that no border lies in a run of spaces")
        return a[0], True, a[2], a[3] + b[3]
    return a[0], True, a[2] + machine.word(a[3] + b[0]) + b[2], b[3]


def finish(machine: Transducer, whole: Map) -> int:
    head, started, n, tail = whole
    return (machine.word(head) if head else 0) + n + (machine.word(tail) if started else 0)


def borders(text: str, size: int) -> list[str]:
    """Chunks of about ``size`` characters; no border lies inside a run of spaces."""
    out, at = [], 0
    while at < len(text):
        to = at + size
        while to < len(text) and text[to] in f" {SPACE}" and text[to - 1] in f" {SPACE}":
            to += 1
        out.append(text[at:to])
        at = to
    return out


def count(machine: Transducer, text: str, size: int = CHUNK) -> int:
    """Tokens of a whole text, by way of its chunks' state maps."""
    if not text:
        return 0
    return finish(machine, reduce(lambda a, b: compose(machine, a, state_map(machine, b)), borders(SPACE + text, size), EMPTY))


def count_tokens(docs: DataFrame, model: str, text: str = "text", name: str = "n_tokens", keep_text: bool = False) -> DataFrame:
    """``docs`` with the number of tokens of each whole text.

    Null and empty texts have 0 tokens; rows may repeat and ids may be null; a column that is already
    called ``name`` is replaced. Texts of over ``SPREAD`` characters are cut into chunks that are
    dealt over all tasks, and their state maps are composed by position.
    """
    docs = docs.drop(name) if name in docs.columns else docs
    long_text = F.length(text) > SPREAD

    def short():
        machine = compiled(model)
        return lambda texts: {name: [count(machine, t) for t in texts]}

    field = [T.StructField(name, T.LongType())]
    few = map_texts(docs.where(F.coalesce(~long_text, F.lit(True))), text, short, field, keep_text)
    rest = [c for c in docs.columns if keep_text or c != text]
    large = docs.where(long_text).select(F.struct(*rest).alias("_row"), F.monotonically_increasing_id().alias("_at"), F.col(text).alias("_text"))
    parts = T.ArrayType(T.StringType())
    cutting = map_texts(large, "_text", lambda: lambda texts: {"_parts": [borders(SPACE + t, SPREAD) for t in texts]}, [T.StructField("_parts", parts)])
    chunks = cutting.select("_at", "_row", F.posexplode("_parts").alias("_no", "_part")).repartition("_at", "_no")
    map_type = T.StructType([T.StructField("h", T.StringType()), T.StructField("w", T.BooleanType()), T.StructField("n", T.LongType()), T.StructField("t", T.StringType())])

    def maps():
        machine = compiled(model)

        def work(texts):
            out = []
            for t in texts:
                m = reduce(lambda a, b: compose(machine, a, state_map(machine, b)), borders(t, CHUNK), EMPTY)
                out.append(dict(zip("hwnt", m, strict=True)))
            return {"_map": out}

        return work

    mapped = map_texts(chunks, "_part", maps, [T.StructField("_map", map_type)])
    joined = mapped.groupBy("_at").agg(F.first("_row").alias("_row"), F.transform(F.array_sort(F.collect_list(F.struct("_no", "_map"))), lambda x: x["_map"]).alias("_maps"))
    row = joined.schema["_row"].dataType
    kept = T.StructType([T.StructField(f.name, f.dataType, f.nullable) for f in row.fields])

    def fold(batches):
        import pyarrow as pa

        machine = compiled(model)
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index("_row"))
            totals = [finish(machine, reduce(lambda a, b: compose(machine, a, tuple(b[k] for k in "hwnt")), ms, EMPTY)) for ms in batch.column(batch.schema.get_field_index("_maps")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(totals, pa.int64())], names=[*(f.name for f in kept), name])

    return few.unionByName(joined.mapInArrow(fold, T.StructType([*kept.fields, *field])))
