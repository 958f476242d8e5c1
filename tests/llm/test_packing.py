import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from millwright.llm import packing
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_fullest_is_optimal():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randrange(1, 30): rng.randrange(1, 4) for _ in range(5)}
        room = rng.randrange(0, 60)
        got = packing.fullest(counts, room)
        sums = {0}
        for k, n in counts.items():
            for _ in range(n):
                sums |= {s + k for s in sums}
        assert sum(k * n for k, n in got.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in got.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    histogram = Counter(min(64, int(rng.expovariate(1 / 20)) + 1) for _ in range(3000))
    planned = packing.plan(histogram, 64)
    used = Counter()
    for times, content in planned:
        assert sum(k * n for k, n in content.items()) <= 64
        for k, n in content.items():
            used[k] += times * n
    assert used == histogram
    assert sum(t for t, _ in planned) <= 1.01 * -(-sum(k * n for k, n in histogram.items()) // 64)


def test_pack(spark):
    rng = random.Random(3)
    texts = [None, "", "a", "Hello,  World's\nend", "ǅ é́ <|startoftext|> x y　z \x1c\x85 İSTANBUL ΣΑΣ", "word " * 5000]
    texts += [" ".join(rng.choices("the of cat's house 12 éa".split(), k=rng.randrange(400))) for _ in range(80)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(None, "n", 1), (2, "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, offset int").repartition(3)
    got = packing.pack(docs, PATH, 128).collect()
    tok = Tokenizer.from_file(PATH)
    want = Counter()
    for i, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 128)):
            own = ids[s : s + 128]
            want[i, k, s, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 128
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 128 + 1
    assert packing.pack(docs.where("false"), PATH).count() == 0
