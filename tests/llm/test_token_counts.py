import random

import public_tokenizers
import sentencepiece
from millwright.llm import token_counts as tc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "   ", "a", "  two  spaces   in a row ", "naïve ▁ text </s> <s> [INST]", "\x00\t\n\r ", "日本語のテキスト と 🙂🙂", "aaaaaaaaaaaaaaaaaaaaaaa", "x" * 300, "ﬁ ① ﻿", " " * 40 + "end", "end" + " " * 40]


def library(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    return [len(x) for x in sp.encode(texts)]


def test_counts_equal_the_library():
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab▁ theéü.\n0") for _ in range(rng.randrange(60))) for _ in range(400)]
    machine = tc.compiled(MODEL)
    assert [tc.count(machine, t) for t in texts] == library(texts)
    # any cut into chunks gives the same count
    assert [tc.count(machine, t, 3) for t in texts] == library(texts)


def test_composition_is_associative():
    machine = tc.compiled(MODEL)
    a, b, c = (tc.state_map(machine, x) for x in ("the qu", "ick bro", "wn fox"))
    left = tc.compose(machine, tc.compose(machine, a, b), c)
    assert left == tc.compose(machine, a, tc.compose(machine, b, c))
    assert tc.compose(machine, tc.EMPTY, a) == a == tc.compose(machine, a, tc.EMPTY)


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(tc, "SPREAD", 20)  # some texts are spread over tasks
    rows = [(i, t, i) for i, t in enumerate(TEXTS)] + [(None, None, 5), (1, "a", 6), (1, "a", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = tc.count_tokens(docs, MODEL).collect()
    want = [(i, n) for (i, _, _), n in zip(rows, library([t or "" for _, t, _ in rows]))]
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens) for r in got) == sorted((i if i is not None else -1, n) for i, n in want)
    assert tc.count_tokens(docs.where("false"), MODEL).count() == 0
