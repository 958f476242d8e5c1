"""Measurement documents with all that is nested in them: sides and holes as tables, corners, design sidecars, and a
sink that writes one document a source.

A document is a row; its stamps, sides and holes are exploded into tables keyed by (file, stamp, side). The sink is a
Python data source: tasks stage whole files inside the target folder, which all machines must share, and only the
job's commit gives them their names, so a failed task leaves no half document.
"""

import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from millwright.functions.scalar import finite_positive, intervals, lines_meet
from millwright.operators.study import corner_phases
from millwright.sources.measurements import FORMAT, PATTERN

# fixed values of the document formats
DESIGN_FORMAT, DESIGN_PATTERN = "stamp-design-size", "data_*_design.json"
SIDES = ("top", "bottom", "left", "right")
CORNERS = (("top", "left"), ("top", "right"), ("bottom", "left"), ("bottom", "right"))
MM_PER_INCH = 25.4
SCHEMA = """format string, source string, dpi string, stamps array<struct<stamp string, summary struct<width_px string, height_px string, width_mm string, height_mm string,
  horizontal_perforation_per_20mm string, vertical_perforation_per_20mm string>, measurement struct<status string, valley_width_px string, valley_height_px string,
  sides map<string, struct<status string, phase int, pitch_px string, line_image array<array<double>>, holes array<struct<id int, accepted boolean, point_image array<double>, refinement struct<model string>>>>>>>>"""
DESIGN_SCHEMA = "format string, source string, stamps array<struct<stamp string, registration_status string, registration_reasons array<string>, design_width_mm string, design_height_mm string>>"


@dataclass(frozen=True)
class Documents:
    """``stamps`` (all of them, with ``reason`` where they are incomplete), their ``sides`` and refined ``holes``, ``corners``,
    ``designs`` and ``errors`` (file, reason)."""

    stamps: DataFrame
    sides: DataFrame
    holes: DataFrame
    corners: DataFrame
    designs: DataFrame
    errors: DataFrame


def _base(file: str, ending: str) -> Column:
    """The file's name without ``data_`` and its ending."""
    return F.regexp_extract(file, rf"(?i)data_([^/]*){ending}$", 1)


def _read(spark: SparkSession, paths: list[str], pattern: str, schema: str, tag: str, recursive: bool) -> tuple[DataFrame, DataFrame]:
    text = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).text(paths, wholetext=True)
    docs = text.select(F.col("_metadata.file_path").alias("file"), "value").withColumn("doc", F.from_json("value", schema))
    reason = F.when(F.get_json_object("value", "$").isNull(), "not valid JSON").when(~F.col("doc.format").eqNullSafe(tag), "unexpected format").when(F.col("doc.stamps").isNull(), "stamps is not a list")
    told = docs.withColumn("reason", reason)
    return told.where("reason is null").select("file", "doc"), told.where("reason is not null").select("file", "reason")


def read_documents(spark: SparkSession, paths: list[str], recursive: bool = False) -> Documents:
    """All tables of the documents under ``paths``. A document or sidecar that can't be used is a row of ``errors``.

    A missing source is the file's name; missing millimetres come from pixels and dpi. Sides without a finite positive
    pitch or a line form no corner. A sidecar counts only beside a usable document of the same name; its
    stamps need both sizes. Tables are read from the files each time they are used.
    """
    docs, errors = _read(spark, paths, PATTERN, SCHEMA, FORMAT, recursive)
    source = F.coalesce(F.nullif("doc.source", F.lit("")), _base("file", r"_perf\.json"))
    each = docs.select("file", source.alias("source"), finite_positive("doc.dpi").alias("dpi"), F.explode("doc.stamps").alias("s")).withColumn("stamp", F.coalesce("s.stamp", F.lit("")))
    m, phases = "s.measurement", F.transform(F.map_values("s.measurement.sides"), lambda v: v.phase)
    flat = each.select(
        "file", "source", "stamp", "dpi", F.coalesce(f"{m}.status", F.lit("unknown")).alias("status"), F.array_max(F.array_compact(phases)).alias("worst_phase"), F.col("s.summary").isNull().alias("_bare"),
        finite_positive("s.summary.horizontal_perforation_per_20mm").alias("horizontal"), finite_positive("s.summary.vertical_perforation_per_20mm").alias("vertical"),
        *[F.coalesce(finite_positive(f"s.summary.{d}_mm"), F.coalesce(finite_positive(f"s.summary.{d}_px"), finite_positive(f"s.measurement.valley_{d}_px")) * MM_PER_INCH / F.col("dpi")).alias(f"{d}_mm") for d in ("width", "height")],
    )
    for d, g in (("width", "horizontal"), ("height", "vertical")):
        n = F.when(F.col(f"{d}_mm").isNotNull() & F.col(g).isNotNull(), intervals(f"{d}_mm", g))
        flat = flat.withColumns({f"{d}_holes": n + 1, f"hole_center_{d}_mm": n * (20.0 / F.col(g))})
    whole = F.col("horizontal").isNotNull() & F.col("vertical").isNotNull()
    stamps = flat.withColumn("reason", F.when(F.col("_bare"), "missing summary").when(~whole, "incomplete gauge pair")).drop("_bare")
    sides = each.select("file", "source", "stamp", F.explode("s.measurement.sides").alias("side", "v"))
    line = lambda i, j: F.try_element_at(F.try_element_at("v.line_image", F.lit(i)), F.lit(j))
    sides = sides.withColumns({"x1": line(1, 1), "y1": line(1, 2), "x2": line(2, 1), "y2": line(2, 2), "pitch_px": finite_positive("v.pitch_px")})
    holes = sides.select("file", "source", "stamp", "side", F.explode("v.holes").alias("h")).select("file", "source", "stamp", "side", "h.id", "h.accepted", F.col("h.refinement.model").alias("model"), F.try_element_at("h.point_image", F.lit(1)).alias("x"), F.try_element_at("h.point_image", F.lit(2)).alias("y"))
    sides = sides.select("file", "source", "stamp", "side", "v.status", "v.phase", "pitch_px", "x1", "y1", "x2", "y2")
    designs, design_errors = _read(spark, paths, DESIGN_PATTERN, DESIGN_SCHEMA, DESIGN_FORMAT, recursive)
    return Documents(stamps, sides, holes, corners_of(sides, holes), designs_of(docs, designs), errors.unionByName(design_errors))


def corners_of(sides: DataFrame, holes: DataFrame) -> DataFrame:
    """(file, source, stamp, corner, phases, mismatch, separation) of the corners where two sides' lines meet and both have
    a refined hole near by. A side's pairs are at most four a stamp."""
    key = ["file", "source", "stamp"]
    good = sides.where("pitch_px is not null and x1 is not null and y1 is not null and x2 is not null and y2 is not null")
    ends = ("x1", "y1", "x2", "y2")
    one = good.select(*key, F.col("side").alias("h"), F.col("pitch_px").alias("h_pitch"), *[F.col(e).alias(f"h_{e}") for e in ends])
    two = good.select(*key, F.col("side").alias("v"), F.col("pitch_px").alias("v_pitch"), *[F.col(e).alias(f"v_{e}") for e in ends])
    met = one.where(F.col("h").isin("top", "bottom")).join(two.where(F.col("v").isin("left", "right")), key)
    x, y = lines_meet(*[f"h_{e}" for e in ends], *[f"v_{e}" for e in ends])
    found = met.select(*key, F.concat_ws("-", "h", "v").alias("corner"), "h", "v", "h_pitch", "v_pitch", x.alias("x"), y.alias("y")).where("x is not null")
    refined = holes.where("model = 'circle' and x is not null and y is not null").select(*key, "side", F.col("x").alias("hx"), F.col("y").alias("hy"))
    near = None
    for name in ("h", "v"):
        own = found.select(*key, "corner", F.col(name).alias("side")).join(refined, [*key, "side"]).select(*key, "corner", F.lit(name).alias("side"), "hx", "hy")
        near = own if near is None else near.unionByName(own)
    return corner_phases(found.select(*key, "corner", "x", "y", "h_pitch", "v_pitch"), near, [*key, "corner"])


def designs_of(docs: DataFrame, designs: DataFrame) -> DataFrame:
    """(file, design_file, source, stamp, sizes, registration) of sidecars beside a usable document; stamps without two finite,
    positive sizes don't count."""
    stem = lambda ending: F.regexp_replace("file", rf"(?i){ending}$", "")
    beside = docs.select("file", stem(r"_perf\.json").alias("_stem"))
    each = designs.select(F.col("file").alias("design_file"), stem(r"_design\.json").alias("_stem"), F.coalesce(F.nullif("doc.source", F.lit("")), _base("file", r"_design\.json")).alias("source"), F.explode("doc.stamps").alias("s"))
    told = each.select("design_file", "_stem", "source", F.coalesce("s.stamp", F.lit("")).alias("stamp"), F.coalesce("s.registration_status", F.lit("unknown")).alias("registration_status"), F.coalesce(F.array_join("s.registration_reasons", "; "), F.lit("")).alias("registration_reasons"), finite_positive("s.design_width_mm").alias("design_width_mm"), finite_positive("s.design_height_mm").alias("design_height_mm"))
    return told.where("design_width_mm is not null and design_height_mm is not null").join(beside, "_stem").drop("_stem")


def _clean(df: DataFrame) -> DataFrame:
    """Numbers that aren't finite become null."""
    return df.select(*[F.when(~F.isnan(f.name) & (F.abs(f.name) < float("inf")), F.col(f.name)).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f.name) for f in df.schema.fields])


def nested(stamps: DataFrame, sides: DataFrame, holes: DataFrame) -> DataFrame:
    """(name, document): one document a source, with its stamps by number, all four sides of each, and their holes numbered
    from 1 along the side.

    ``stamps``: source, dpi, stamp, status, horizontal, vertical, valley_width_px, valley_height_px; ``sides``: source,
    stamp, side, and whatever else a side has; ``holes``: source, stamp, side, position, accepted, model, x, y. A
    side without a row is ``unavailable``. A document is one row: it is as large as its source has stamps. Null sources
    and stamps don't count.
    """
    key = ["source", "stamp"]
    h = _clean(holes)
    circle = F.coalesce(F.col("model") == "circle", F.lit(False))
    category = F.when(circle & F.col("accepted"), "perforation").when(circle, "ignored_perforation").otherwise("approximation")
    point = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), F.array("x", "y"))
    hole = F.struct(F.coalesce("position", F.lit(float("inf"))).alias("position"), F.coalesce("accepted", F.lit(False)).alias("accepted"), point.alias("point_image"), F.when(F.col("model").isNotNull(), F.struct("model")).alias("refinement"), category.alias("category"))
    listed = h.groupBy(*key, "side").agg(F.array_sort(F.collect_list(hole)).alias("_holes"))
    numbered = F.transform("_holes", lambda x, i: F.struct((i + 1).alias("id"), x.accepted.alias("accepted"), x.point_image.alias("point_image"), x.refinement.alias("refinement"), x.category.alias("category")))
    known = _clean(stamps).where("source is not null and stamp is not null")
    every = known.select(*key, F.explode(F.array(*[F.lit(s) for s in SIDES])).alias("side"))
    own = [c for c in sides.columns if c not in (*key, "side", "status")]
    told = every.join(_clean(sides), [*key, "side"], "left").join(listed, [*key, "side"], "left")
    none = F.array().cast("array<struct<id:int,accepted:boolean,point_image:array<double>,refinement:struct<model:string>,category:string>>")
    side = F.struct(F.coalesce("status", F.lit("unavailable")).alias("status"), F.when(F.col("status").isNull(), "no orientation").alias("reason"), *own, F.coalesce(F.when(F.col("_holes").isNotNull(), numbered), none).alias("holes"))
    grouped = told.groupBy(*key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("side", side.alias("v"))), lambda a, b: F.when(a.side < b.side, -1).when(a.side > b.side, 1).otherwise(0))).alias("sides"))
    mm = lambda c: F.round(F.col(c) * MM_PER_INCH / F.col("dpi"), 4)
    summary = F.struct("source", "stamp", F.col("valley_width_px").alias("width_px"), F.col("valley_height_px").alias("height_px"), mm("valley_width_px").alias("width_mm"), mm("valley_height_px").alias("height_mm"), F.round("horizontal", 4).alias("horizontal_perforation_per_20mm"), F.round("vertical", 4).alias("vertical_perforation_per_20mm"))
    made = known.join(grouped, key).select("source", "dpi", F.struct("stamp", summary.alias("summary"), F.struct("status", "valley_width_px", "valley_height_px", "sides").alias("measurement")).alias("s"))
    docs = made.groupBy("source").agg(F.max("dpi").alias("dpi"), F.array_sort(F.collect_list("s"), lambda a, b: F.when(a.stamp < b.stamp, -1).when(a.stamp > b.stamp, 1).otherwise(0)).alias("stamps"))
    whole = F.struct(F.lit(FORMAT).alias("format"), F.lit(1).alias("version"), "source", "dpi", "stamps")
    return docs.select(F.concat(F.lit("data_"), F.regexp_replace("source", r"[^A-Za-z0-9._-]", "_"), F.lit("_perf.json")).alias("name"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("document"))


@dataclass
class _Staged(WriterCommitMessage):
    names: list


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.removeprefix("file://"), overwrite
        self.stage = os.path.join(self.path, f"_staged-{uuid.uuid4().hex}")

    def write(self, rows):
        names = []
        os.makedirs(self.stage, exist_ok=True)
        for row in rows:
            # tries of one task don't share files
            staged = f"{uuid.uuid4().hex}.part"
            with open(os.path.join(self.stage, staged), "w", encoding="utf-8") as out:
                out.write(row["document"])
            names.append((staged, row["name"]))
        return _Staged(names)

    def commit(self, messages):
        pairs = [p for m in messages if m is not None for p in m.names]
        if len({name for _, name in pairs}) < len(pairs):
            self.abort(messages)
            raise ValueError("two documents have one name")
        if self.overwrite:
            for old in os.listdir(self.path) if os.path.isdir(self.path) else []:
                if old.startswith("data_") and old.endswith("_perf.json"):
                    os.remove(os.path.join(self.path, old))
        for staged, name in pairs:
            os.replace(os.path.join(self.stage, staged), os.path.join(self.path, name))
        shutil.rmtree(self.stage, ignore_errors=True)

    def abort(self, messages):
        shutil.rmtree(self.stage, ignore_errors=True)


class MeasurementDocuments(DataSource):
    """Writes (name, document) rows as files of a folder that all machines share. ``spark.dataSource.register`` it first."""

    @classmethod
    def name(cls):
        return "measurement_documents"

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite)


def write_documents(stamps: DataFrame, sides: DataFrame, holes: DataFrame, path: str, overwrite: bool = False) -> None:
    """Documents of all sources under ``path``; all of them or, if anything fails, none."""
    stamps.sparkSession.dataSource.register(MeasurementDocuments)
    nested(stamps, sides, holes).write.format("measurement_documents").mode("overwrite" if overwrite else "append").save(path)
