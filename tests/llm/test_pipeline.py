"""The pipeline's stages, each on what its predecessor kept, against brute force on a small table with odd rows."""

import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import public_tokenizers
import pytest
from millwright.store import cut
from pyspark.sql import functions as F
from test_repeats import SPAN
from tokenizers import Tokenizer

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """The smallest documents and labels, with nulls, empty and repeated rows, a copy, a near copy and a shared passage."""
    path = tmp_path_factory.mktemp("corpus")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = sorted((r.text for r in docs.collect() if len(r.text.split()) > 150), key=lambda t: (len(t), t))
    words = texts[5].split(" ")
    passage = "ü" + texts[-1][1000:1900]
    odd = [(None, texts[3] + " more", None, None, None), (90001, None, "en", "src1", 5), (90002, "", "en", None, 0), (90003, texts[4], "en", "src1", None), (90003, texts[4], "en", "src1", None), (90004, " ".join([*words[:-1], "changed"]), None, "src2", 9), (90005, texts[7] + passage, "de", "src1", 1), (90006, texts[8] + passage, "de", "src1", 1)]
    docs.unionByName(spark.createDataFrame(odd, docs.schema)).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/labels.parquet").write.parquet(f"{path}/labels.parquet")
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def components(texts, size=5, percent=80):
    """For each text the first one that links of likeness ``percent`` lead to."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)})
    boss = list(range(len(texts)))

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                boss[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(texts))]


def unique(text, seen):
    """``text`` without each character any of whose bytes lies in a SPAN of bytes that occurs twice."""
    data = text.encode()
    gone = bytearray(len(data))
    for i in range(len(data) - SPAN + 1):
        if seen[data[i : i + SPAN]] > 1:
            gone[i : i + SPAN] = b"\1" * SPAN
    out, at = [], 0
    for c in text:
        n = len(c.encode())
        if not any(gone[at : at + n]):
            out.append(c)
        at += n
    return "".join(out)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, [rows(docs)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut(stage(spark, docs, folder), "test-" + name.replace(" ", "-"))
        assert docs.columns == columns
        kept.append(rows(docs))
    given, good, ruled, single, cleaned = map(Counter, kept)
    at = columns.index("text")
    # filters keep rows as they are; what the rules' base drops is gone
    assert not good - given and not ruled - good and not single - ruled
    for row in ruled:
        words = re.findall(r"[^\x20\x09-\x0D]+", row[at] or "")
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        again = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        assert len(words) >= 50 and 100 * len(again) <= 50 * len(words)
    assert sum(ruled.values()) > 60
    # one row of each component stays
    before = list(ruled.elements())
    labels = components([r[at] for r in before])
    groups = defaultdict(list)
    for row, label in zip(before, labels):
        groups[label].append(row)
    assert sum(single.values()) == len(groups)
    for members in groups.values():
        assert sum(min(single[m], 1) for m in set(members)) == 1
    # repeated strings are cut out, and nothing else changes
    seen = Counter(b[i : i + SPAN] for r in single.elements() for b in [(r[at] or "").encode()] for i in range(len(b) - SPAN + 1))
    want = Counter((r[0], unique(r[at] or "", seen)) for r in single.elements())
    assert Counter((r[0], r[at] or "") for r in cleaned.elements()) == want
    # every piece has its place, and places fill their sequences without gaps
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    pieces = Counter()
    for r in cleaned.elements():
        ids = [*tokenizer.encode(r[at] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = ids[k : k + 2048]
            pieces[r[0], k // 2048, k, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in packed) == pieces
    sequences = defaultdict(list)
    for p in packed:
        sequences[p.sequence_id].append((p.offset, p.length))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
