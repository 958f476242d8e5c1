"""Fill-in-the-middle: texts cut at two unit borders and written prefix, suffix, middle or suffix, prefix, middle.

A text's bytes become big integers with a bit for each byte: ``bytes.translate`` writes the digits of a
class's mask, shifted boolean operations on the masks mark where units start, ``bit_count`` counts the
units, and recursive halving finds the start of unit k. No unit is ever made a string of its own.
"""

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millwright.llm.batches import pieces

#: Marks of prefix, suffix and middle; a text that holds one stays plain.
MARKS = ("<P>", "<S>", "<M>")
FIELDS = [T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType())]


def _digits(belongs) -> bytes:
    return bytes(b"01"[belongs(b)] for b in range(256))


#: Translation tables: a byte becomes the digit 1 if it is of the class.
NEWLINE = _digits(lambda b: b == 0x0A)
SPACE = _digits(lambda b: b == 0x20 or 0x09 <= b <= 0x0D)
HEAD = _digits(lambda b: b & 0xC0 != 0x80)


def mask(data: bytes, table: bytes) -> int:
    """Bit i is set if byte i is of the table's class."""
    return int(data[::-1].translate(table), 2) if data else 0


def starts(data: bytes, unit: str) -> int:
    """Bit i is set if a unit starts at byte i. Lines end after their newline, words after the white space
    that follows them; what is left at the end is a unit too."""
    full = (1 << len(data)) - 1
    if unit == "line":
        return (mask(data, NEWLINE) << 1 | 1) & full
    if unit == "word":
        space = mask(data, SPACE)
        return (~space & space << 1 | 1) & full
    if unit == "char":
        return mask(data, HEAD)
    raise ValueError(f"no such unit: {unit}")


def select(bits: int, width: int, k: int) -> int:
    """Place of set bit ``k`` (from 0) of ``bits``, which are ``width`` wide; ``width`` if there are not as many."""
    if k >= bits.bit_count():
        return width
    at = 0
    while width > 1:
        half = width >> 1
        low = bits & ((1 << half) - 1)
        below = low.bit_count()
        if k < below:
            bits, width = low, half
        else:
            bits, width, k, at = bits >> half, width - half, k - below, at + half
    return at


def cut(data: bytes, unit: str, draws: tuple[int, int]) -> tuple[int, int, int]:
    """(units, byte where the prefix ends, byte where the middle ends)."""
    marked = starts(data, unit)
    n = marked.bit_count()
    first, second = sorted(d % (n + 1) for d in draws)
    return n, select(marked, len(data), first), select(marked, len(data), second)


def draws(doc_id: str, seed: int) -> Column:
    """Hex digest that the four draws of a row are read from; a null id counts as empty text."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "line", seed: int = 7, rate: int = 100, spm: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """``docs`` without the text, with n, form, prefix_chars, middle_chars and output.

    Of texts that are neither empty nor hold a mark, ``rate`` percent are cut, ``spm`` percent of these
    suffix first; all draws come from a hash of the id, so equal ids get equal draws and repeated rows
    repeated results. A null text is empty, and like any empty text it is plain, with n = 0 and no
    chars; a null id draws as an empty one. Columns of ``docs`` with the names of new ones are replaced.
    An empty table gives an empty one. One row is one task's work however long its text; memory is a few
    times that text.
    """
    if len(set(marks)) != 3 or not all(marks) or any(a.startswith(b[k:]) for a in marks for b in marks for k in range(1, len(b))):
        raise ValueError("marks must be three texts, none of which may start with another's end")
    made = {f.name for f in FIELDS}
    kept = [f for f in docs.schema.fields if f.name != text and f.name not in made]
    schema = T.StructType([*kept, *FIELDS])
    arrow = to_arrow_schema(schema)
    p, s, m = (x.encode() for x in marks)

    def one(data: bytes, draw: str) -> tuple:
        h = [int(draw[i : i + 8], 16) for i in range(0, 32, 8)]
        n, a, b = cut(data, unit, (h[0], h[1]))
        if not data or p in data or s in data or m in data or h[2] % 100 >= rate:
            return n, "plain", None, None, data
        heads = mask(data, HEAD)
        upto = (heads & ((1 << a) - 1)).bit_count()
        inside = (heads & ((1 << b) - 1)).bit_count() - upto
        if h[3] % 100 < spm:
            return n, "spm", upto, inside, b"".join((s, data[b:], p, data[:a], m, data[a:b]))
        return n, "psm", upto, inside, b"".join((p, data[:a], s, data[b:], m, data[a:b]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_text")
            for a, b in pieces(texts):
                part = batch.slice(a, b - a)
                rows = [one(t.as_buffer().to_pybytes() if t.is_valid else b"", d) for t, d in zip(part.column("_text"), part.column("_draw").to_pylist(), strict=True)]
                new = [pa.array([r[i] for r in rows], arrow.field(f.name).type) for i, f in enumerate(FIELDS[:-1])]
                out = pa.array([r[-1] for r in rows], pa.binary()).cast(arrow.field("output").type)
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *new, out], schema=arrow)

    return docs.select(*[f.name for f in kept], F.col(text).alias("_text"), draws(doc_id, seed).alias("_draw")).mapInArrow(run, schema)


def restored(output: str = "output", form: str = "form", marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` of form ``form`` was made from."""
    part = F.split(F.col(output), "|".join(re.escape(x) for x in marks), -1)
    psm, spm = F.concat(part[1], part[3], part[2]), F.concat(part[2], part[3], part[1])
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(F.col(output))


def digests(made: DataFrame) -> DataFrame:
    """The contract's columns: digests in place of the texts."""
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(), 256).alias("restored_sha256"))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
p AS (SELECT doc_id, t, n, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf,
CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
