"""A training corpus from the raw documents, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and is written
and read again as the next one's input. All but the last return the columns of ``documents``.

Null and empty texts are judged as empty ones: the rules drop them, as they have fewer than 50 words. Rows with a null
id are judged like others; of a group of near copies the smallest id that isn't null stays, and of repeated rows one.
Nulls in other columns pass through. A repeated string goes from every text that holds it; n_chars, where there, follows
the text. Ties don't arise but in packing, where any place will do. Empty tables give empty results. Other columns aren't read.
"""

import public_tokenizers

from millwright.llm import near_dedup, packing, quality_classifier, quality_rules, repeats
from millwright.store import cut


def quality(spark, docs, sf_dir):
    """Documents that the subword classifier scores below 0.7 go."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def rules(spark, docs, sf_dir):
    """Documents that fail the base rules or whose posterior quality is below one half go."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies stays: shingles of five words, likeness 0.8."""
    return near_dedup.keep_one(docs)


def repeated_strings(spark, docs, sf_dir):
    """Strings of 400 bytes that start anywhere else too are cut out of the texts."""
    return repeats.remove_repeats(docs)


def sequences(spark, docs, sf_dir):
    """Tokenized pieces and their places in sequences of 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("quality rules", rules),
    ("near-duplicates", near_duplicates),
    ("repeated strings", repeated_strings),
    ("packing", sequences),
]

#: Training, expectation-maximisation, components and packing are not expressible in SQL. tests/llm/test_pipeline.py
#: holds every stage against brute force on its own input, tests/llm the operators.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages, applied to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
