"""Functions over whole texts, applied to Arrow batches; other columns pass through unchanged."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Texts of a batch that are worked on together; bounds what a Python worker holds.
BATCH_CHARS = 8 << 20


_resident: dict = {}


def resident(key, make: Callable):
    """What ``make()`` gave for ``key`` in this Python worker. Only the last key's is held.

    Workers live on from stage to stage, so that tables of one operator would else stay in memory under
    the next one.
    """
    if key not in _resident:
        vacate()
        _resident[key] = make()
    return _resident[key]


def vacate() -> None:
    """Drops what ``resident`` holds; for tasks that need no such table, but would work beside an earlier operator's."""
    _resident.clear()
    pa.default_memory_pool().release_unused()


def apart(docs: DataFrame, text: str = "text") -> DataFrame:
    """(_row, _text): the row without its text, and the text, so that it travels once."""
    return docs.select(F.struct(*[F.lit(None).cast("string").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{text}`").alias("_text"))


def together(columns: list[str], text: str = "text") -> list[Column]:
    """The ``columns`` that ``apart`` took apart."""
    return [F.col("_text").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in columns]


def pieces(texts: pa.Array, limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Row ranges of ``texts`` that hold about ``limit`` bytes each, one row at least."""
    at, held = 0, 0
    for i, s in enumerate(texts):
        held += len(s.as_buffer()) if s.is_valid else 0
        if held >= limit:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def map_texts(df: DataFrame, text: str, make: Callable[[], Callable[[list[str]], dict]], fields: list[T.StructField], keep_text: bool = False, key=None) -> DataFrame:
    """``df`` with the columns that ``make()(texts)`` returns for the column ``text``; null counts as empty.

    ``make`` runs once a task, or with ``key`` once a Python worker (see ``resident``). The text column goes unless
    ``keep_text``.
    """
    kept = [f for f in df.schema.fields if keep_text or f.name != text]
    schema = T.StructType([*kept, *fields])
    new = to_arrow_schema(T.StructType(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key is None:
            vacate()
        work = make() if key is None else resident(key, make)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            for a, b in pieces(column):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in column.slice(a, b - a).to_pylist()]
                made = work(texts)
                arrays = [part.column(part.schema.get_field_index(f.name)) for f in kept] + [pa.array(made[f.name], f.type) for f in new]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in schema.fields])

    return df.mapInArrow(run, schema)
