"""Bounded samples of labelled documents, and what is held out from learning."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millwright.store import Cut


def held_out(doc_id: str, parts: int, part: int) -> Column:
    """Whether ``crc32(doc_id as text) mod parts`` is ``part``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, held: tuple[int, int], each: int) -> tuple[Cut, dict[int, int]]:
    """(order, label, text) of at most ``each`` labelled, not held-out documents of either class, and
    how many there are of each class.

    Taken in the order of a hash of the id, so the same rows come whatever the partitioning. Null ids
    and labels don't count; of several labels of a document the largest does; of several documents with
    one id all do. At most 2 * each ids are broadcast.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out("doc_id", *held))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).withColumn("order", F.xxhash64("doc_id"))
    sizes = {int(r["label"]): int(r["count"]) for r in known.groupBy("label").count().collect()}
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy("order", "doc_id").limit(each)
        picked = part if picked is None else picked.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("order", "label", F.coalesce("text", F.lit("")).alias("text"))
    return Cut(found, f"sample-{label}"), sizes
