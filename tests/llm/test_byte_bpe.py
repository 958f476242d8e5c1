import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import tiktoken
from millwright.llm import byte_bpe as bb
from millwright.store import cut

RANKS = P.path("byte_bpe_50k.tiktoken")


def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_numbers_round_trip():
    x = np.array([0, 1, 127, 128, 16383, 16384, 2**21 - 1, 2**21, 2**28 - 1])
    assert bb.unpack_numbers(bb.pack_numbers(x)).tolist() == x.tolist()
    assert bb.pack_numbers(x[:0]) == b"" and len(bb.unpack_numbers(b"")) == 0


def texts():
    rng = random.Random(6)
    fixed = [None, "", " ", "  ", "a  b", "a   b", " a ", "x \n y", "x\n  \ny", "don't  'stop", "　\x85\x1c \xa0 a", "日本 語🙂", "a 　b", "<|endoftext|> x", "word " * 20_000, "x" * 5000]
    return fixed + ["".join(rng.choice(["a", "b1", " ", "  ", "\n", "'s", "é", "!", "\t", "\x1c", " "]) for _ in range(rng.randrange(40))) for _ in range(500)]


def test_words_join_to_the_text_and_keep_the_ids():
    enc = library()
    for t in texts():
        if t:
            ws = bb.words(t)
            assert "".join(ws) == t
            assert [i for w in ws for i in enc.encode_ordinary(w)] == enc.encode_ordinary(t)


def test_words_around_alternating_white_space():
    enc = library()
    for t in ["a \xa0 \xa0 b", "a" + " \xa0" * 4 + " b", "a\xa0 \xa0 b c", "a \u2003 \xa0b \n c", " \xa0 \xa0 ", "x \xa0 \t y z"]:
        ws = bb.words(t)
        assert "".join(ws) == t
        assert [i for w in ws for i in enc.encode_ordinary(w)] == enc.encode_ordinary(t)
    assert bb.words("a b \xa0 c d") == ["a", " b \xa0 c", " d"]


def test_rows_equal_the_library(spark):
    enc = library()
    rows = [(i, t, 1) for i, t in enumerate(texts())] + [(None, "null id", 1), (5, "again", 1), (5, "again", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int").repartition(3)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bb.encode_decode(docs, RANKS, P.PATTERN).collect())
    want = []
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((-1 if i is None else i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    stored = cut(docs, "test-docs")
    twice = sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bb.encode_decode(stored, RANKS, P.PATTERN, stable=True).collect())
    assert twice == got
    assert bb.encode_decode(docs.where("false"), RANKS, P.PATTERN).count() == 0
    assert bb.ids_of(docs.where("doc_id = 5"), RANKS, P.PATTERN).count() == 3


def test_pre_tokens_are_the_library_s():
    import regex

    enc, pattern = library(), regex.compile(P.PATTERN)
    rng = random.Random(8)
    for _ in range(3000):
        t = "".join(rng.choice(["a", "É", "ß", "日本", "한", "ж", "1", "²", "٣", "'s", "'", "_", "!", "\n", "\xa0", "\x1c", "\x85", "᠎", "🙂", "́", " x"]) for _ in range(rng.randrange(12)))
        runs = bb.words(t)
        found, sizes = bb.pre_tokens(runs, pattern)
        assert sum(sizes) == len(found)
        for run, n in zip(runs, sizes, strict=True):
            own, found = found[:n], found[n:]
            assert "".join(own) == run
            assert [i for w in own for i in enc.encode_ordinary(w)] == enc.encode_ordinary(run)
    assert bb.pre_tokens([" l'été,\n\n12"], pattern)[0] == [" l", "'", "été", ",", "\n", "\n", "12"]
    assert bb.pre_tokens(["日本。語"], pattern)[0] == ["日本", "。", "語"]
    assert bb.pre_tokens([], pattern)[0] == []


def test_blocks_of_any_size_give_the_same(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), "test-blocks")
    want = sorted(tuple(r) for r in bb.encode_decode(docs, RANKS, P.PATTERN, stable=True).collect())
    shards = {r.shard for r in bb._blocks(docs, 8, P.PATTERN).collect()}
    assert shards == {None, *range(8)}
    monkeypatch.setattr(bb, "MAX_WORDS", 3)
    assert sorted(tuple(r) for r in bb.encode_decode(docs, RANKS, P.PATTERN).collect()) == want


def test_counts_of_words_follow_the_texts(monkeypatch):
    rng = np.random.default_rng(4)
    held = [rng.integers(0, 3000, rng.integers(0, 60)).astype(t) for _ in range(2000) for t in (np.int32, np.int64)]
    want = np.bincount(np.concatenate(held), minlength=3100)
    made = []
    counted = np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, minlength: made.append(minlength) or counted(x, minlength=minlength))
    assert (bb.occurrences(held, 3100) == want).all()
    assert sum(made) <= 2 * sum(map(len, held)) + 3100
    assert bb.occurrences([], 3).tolist() == [0, 0, 0] and len(bb.occurrences([np.zeros(0, np.int32)], 0)) == 0
