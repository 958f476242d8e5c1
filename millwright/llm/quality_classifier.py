"""A supervised classifier on learned subword vectors.

Every word stands for the hashed vectors of itself and of its character n-grams, and every two
neighbouring words for those of their bigram and of its subwords: the pairs of their first characters,
of their first two and of their last two. A document is the mean of all its vectors, a softmax
layer gives the two class probabilities, and vectors and layer are trained together by stochastic
gradient descent in numpy on a bounded sample of labelled documents.

The layer is linear in the mean, so that for scoring each bucket of the hash needs only one number,
its vector's product with the difference of the class weights: ``BUCKETS + PAIRS`` floats go to the
workers.
"""

import uuid
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millwright.llm.batches import apart, map_texts, together
from millwright.llm.labelled import held_out, sample

#: buckets of words and their character n-grams, and of word bigrams
BUCKETS, PAIRS = 1 << 18, 1 << 18
GRAMS = (2, 3)
MAX_WORDS = 300_000  # that a worker remembers; a matter of memory, not of results
LONG = 200  # characters; longer words go in pieces and are not remembered
PIECE = 1 << 16  # n-grams of a long word that are made together


def features(word: str) -> list[int]:
    """Buckets of a word and of its character n-grams, word ends marked."""
    marked = f"<{word}>".encode("utf-8", "surrogatepass")
    out = [zlib.crc32(b"w" + marked)]
    for n in GRAMS:
        out += [zlib.crc32(marked[i : i + n]) for i in range(len(marked) - n + 1)]
    return [x % BUCKETS for x in out]


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (table & np.uint32(1)) * np.uint32(0xEDB88320)
    return table


CRC = _crc_table()


def long_features(word: str) -> Iterator[np.ndarray]:
    """``features`` of a long word, whole, in arrays of bounded size."""
    marked = f"<{word}>".encode("utf-8", "surrogatepass")
    yield np.array([zlib.crc32(b"w" + marked) % BUCKETS], np.int64)
    data = np.frombuffer(marked, np.uint8)
    for at in range(0, len(data), PIECE):
        for n in GRAMS:
            part = data[at : at + PIECE + n - 1]
            size = max(0, len(part) - n + 1)
            made = np.full(size, 0xFFFFFFFF, np.uint32)
            for k in range(n):
                made = CRC[(made ^ part[k : k + size]) & np.uint32(255)] ^ (made >> np.uint32(8))
            yield (~made % np.uint32(BUCKETS)).astype(np.int64)


PARTS = 4


def pair_hashes(word: str) -> tuple[int, ...]:
    """Of the word itself and of the parts of it that pair with a neighbour's."""
    return tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in (word, word[:1], word[:2], word[-2:]))


def pair_buckets(hashes: np.ndarray) -> np.ndarray:
    """Buckets of the bigrams of neighbouring words, given the rows of the words' ``pair_hashes``."""
    h = hashes.astype(np.uint64)
    mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.arange(h.shape[1], dtype=np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
    return BUCKETS + (mixed >> np.uint64(40)).astype(np.int64).ravel() % PAIRS


@dataclass
class Model:
    scores: np.ndarray  # one float32 for each bucket
    bias: float


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    words = text.split()
    seen = Counter(words)
    if not seen:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    at = {w: k for k, w in enumerate(seen)}
    pairs = pair_buckets(np.array([pair_hashes(w) for w in seen], np.int64)[np.fromiter(map(at.__getitem__, words), np.int64, len(words))])
    long = {w: seen.pop(w) for w in [w for w in seen if len(w) > LONG]}
    lists = list(map(features, seen))
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    parts = [np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), pairs]
    times = [np.repeat(np.fromiter(seen.values(), float, len(seen)), sizes), np.ones(len(pairs))]
    for word, n in long.items():
        for part in long_features(word):
            parts.append(part)
            times.append(np.full(len(part), float(n)))
    ids, place = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(place, np.concatenate(times))
    return ids.astype(np.int32), (total / total.sum()).astype(np.float32)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, size: int = 8, epochs: int = 5, rate: float = 6.0, batch: int = 32, seed: int = 1) -> Model:
    """Vectors and softmax layer by SGD; with fewer than two classes the prior alone."""
    if len(set(labels.tolist())) < 2:
        share = (float(labels.sum()) + 1) / (len(labels) + 2)
        return Model(np.zeros(BUCKETS + PAIRS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = (rng.random((BUCKETS + PAIRS, size), np.float32) - 0.5) / size
    layer = (rng.random((2, size), np.float32) - 0.5) / size
    bias = np.zeros(2, np.float32)
    goal = np.eye(2, dtype=np.float32)[labels]
    steps, done = epochs * max(1, -(-len(bags) // batch)), 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            step = rate * (1 - done / steps)
            done += 1
            ids = np.concatenate([bags[r][0] for r in rows])
            share = np.concatenate([bags[r][1] for r in rows])
            place = np.repeat(np.arange(len(rows)), [len(bags[r][0]) for r in rows])
            mean = np.zeros((len(rows), size), np.float32)
            taken = vectors[ids]
            for k in range(size):
                mean[:, k] = np.bincount(place, taken[:, k] * share, len(rows))
            z = mean @ layer.T + bias
            z = np.exp(z - z.max(1, keepdims=True))
            off = (z / z.sum(1, keepdims=True) - goal[rows]) * weights[rows][:, None]
            back = off @ layer
            layer -= step / len(rows) * off.T @ mean
            bias -= step / len(rows) * off.sum(0)
            own, at = np.unique(ids, return_inverse=True)
            for k in range(size):
                vectors[own, k] -= step * np.bincount(at, back[place, k] * share, len(own))
    return Model((vectors @ (layer[1] - layer[0])).astype(np.float32), float(bias[1] - bias[0]))


class _Words(dict):
    """word -> its row in three growing arrays: sum of its buckets' scores, number of them, pair hashes."""

    def __init__(self, scores: np.ndarray):
        super().__init__()
        self.array = scores
        self.scores = scores.tolist()
        self.fresh()

    def fresh(self) -> None:
        self.clear()
        self.sums, self.sizes, self.hashes = array("d"), array("q"), array("q")

    def __missing__(self, word: str) -> int:
        if len(word) > LONG:
            total, n = 0.0, 0
            for ids in long_features(word):
                total += float(self.array[ids].sum(dtype=float))
                n += len(ids)
        else:
            ids = features(word)
            total, n = sum(map(self.scores.__getitem__, ids)), len(ids)
        at = len(self.sums)
        self.sums.append(total)
        self.sizes.append(n)
        self.hashes.extend(pair_hashes(word))
        if len(word) <= LONG:
            self[word] = at
        return at


def scores(model: Model, known: _Words, texts: list[str]) -> np.ndarray:
    """Probabilities of label 1 of whole texts; 0.5 moved by the bias alone where there is no word."""
    if len(known.sums) > MAX_WORDS:
        known.fresh()
    rows = [np.array(list(map(known.__getitem__, t.split())), np.int64) for t in texts]
    sums, sizes, hashes = np.array(known.sums), np.array(known.sizes), np.array(known.hashes).reshape(-1, PARTS)
    z = np.zeros(len(texts))
    for i, row in enumerate(rows):
        if len(row):
            pairs = model.scores[pair_buckets(hashes[row])]
            z[i] = (sums[row].sum() + pairs.sum(dtype=float)) / (sizes[row].sum() + len(pairs))
    return 1 / (1 + np.exp(-np.clip(z + model.bias, -60, 60)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", held: tuple[int, int] = (4, 2), each: int = 2000) -> Model:
    """A model from at most ``each`` documents of either class; classes count as often as they occur."""
    rows, sizes = sample(docs, labels, label, held, each)

    def make():
        def work(texts):
            made = [bag(t) for t in texts]
            return {"ids": [a for a, _ in made], "shares": [b for _, b in made]}

        return work

    got = map_texts(rows.df, "text", make, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("shares", T.ArrayType(T.FloatType()))]).select("order", "label", "ids", "shares").toArrow()
    rows.drop()
    columns = [got.column(k).combine_chunks() for k in got.column_names]
    order, y = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in columns[:2])
    ids, shares, at = columns[2].flatten().to_numpy(), columns[3].flatten().to_numpy(), np.r_[0, np.cumsum(columns[2].value_lengths().to_numpy())].astype(np.int64)
    sort = np.lexsort((y, order))
    bags, y = [(ids[at[i] : at[i + 1]], shares[at[i] : at[i + 1]]) for i in sort], y[sort]
    each_class = np.bincount(y, minlength=2)
    factor = np.array([sizes.get(c, 0) / max(1, each_class[c]) for c in (0, 1)])
    weights = factor[y] / max(1e-9, float(factor[y].mean())) if len(y) else np.zeros(0)
    return train(bags, y, weights.astype(np.float32))


def with_score(docs: DataFrame, model: Model, text: str = "text", name: str = "score", keep_text: bool = False) -> DataFrame:
    """``docs`` with the probability of label 1 of each whole text; null and empty texts get the bias's."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        known = _Words(m.scores)
        return lambda texts: {name: scores(m, known, texts)}

    return map_texts(docs, text, make, [T.StructField(name, T.DoubleType())], keep_text, f"classifier {uuid.uuid4().hex}")


def classify(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (4, 2), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null ids are kept and are never held out; repeated rows get equal scores; an empty table of labels
    gives the score 0.5 everywhere; an empty table of documents an empty result. Other columns play no
    part.
    """
    model = fit(docs, labels, held=held)
    scored = with_score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id", *held).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, held: tuple[int, int] = (4, 2)) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with their columns and no others."""
    model = fit(docs, labels, held=held)
    return with_score(apart(docs), model, "_text", "_score", True).where(F.col("_score") >= threshold).select(*together(docs.columns))
