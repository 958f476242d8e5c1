import pyarrow as pa
import pytest
from millwright.llm import batches, quality_classifier, quality_rules
from pyspark.sql import types as T

TEXT = T.StructField("text", T.StringType())


class Table:
    """Stands for a DataFrame of texts; gives the task itself."""

    schema = T.StructType([TEXT])

    def mapInArrow(self, run, schema):  # noqa: N802
        return lambda *texts: [x for b in run(iter([pa.RecordBatch.from_arrays([pa.array([t], pa.string())], names=["text"]) for t in texts])) for x in b.column("n").to_pylist()]


def test_tasks_drop_tables_of_earlier_operators(monkeypatch):
    monkeypatch.setattr(batches, "_resident", {})
    made = []

    def make():
        made.append(1)
        return lambda texts: {"n": [len(t) for t in texts]}

    fields = [T.StructField("n", T.LongType())]
    batches.resident("packing", list)
    plain = batches.map_texts(Table(), "text", make, fields)
    assert plain("ab", None) == [2, 0] and not batches._resident
    batches.resident("packing", list)
    keyed = batches.map_texts(Table(), "text", make, fields, key="scores")
    assert keyed("ab", "c") == [2, 1] and keyed("d") == [1]
    assert list(batches._resident) == ["scores"] and len(made) == 2  # the keyed one was made once


@pytest.mark.parametrize("stage", [lambda docs: quality_classifier.keep_good(docs, docs.selectExpr("doc_id", "1 quality")), quality_rules.keep_good])
def test_each_text_travels_once_through_the_filters(spark, monkeypatch, stage):
    rows = [(1, "marked " + "word " * 60, "en", 3), (2, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars int")
    sent, real = [], batches.map_texts
    for module in (quality_classifier, quality_rules):
        monkeypatch.setattr(module, "map_texts", lambda df, *rest: sent.append("".join(df.toJSON().collect())) or real(df, *rest))
    stage(docs)
    assert sent[-1].count("marked") == 1


def test_rows_come_together_again(spark):
    rows = [(1, "a", "x", None), (None, None, None, 2), (1, "a", "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, `a.b` string, text string, n int")
    back = batches.apart(docs).select(*batches.together(docs.columns))
    assert back.dtypes == docs.dtypes and sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
