"""Writers of the programs' files. Each writes a folder of one part, or rows by key, through Spark's own writers."""

from __future__ import annotations

import json
import os
import re
import shutil
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rimlight.operators import etl
from rimlight.plans import evaluate
from rimlight.sources.files import ANNOTATION


def number(c: Column, digits: int = 4) -> Column:
    """A number as text with fixed digits, rounded as C does: by its exact binary value, real ties to even.

    The scaled value is taken as a product and its exact error, so that what looks like a tie in decimal is told from
    one. Beyond 2 ** 53 the scaled value is whole anyway.
    """
    x, scale = F.abs(c.cast("double")), float(10**digits)
    p = x * scale
    split = x * 134217729.0
    high = split - (split - x)
    error = (high * scale - p) + (x - high) * scale
    low = F.floor(p)
    up = F.when(p - low != 0.5, p - low > 0.5).when(error != 0, error > 0).otherwise(low % 2 == 1)
    whole = low + up.cast("long")
    text = F.format_string(f"%s%d.%0{digits}d", F.when(c < 0, "-").otherwise(""), (whole / scale).cast("long"), whole % (10**digits))
    exact = F.bround(c.cast("double").cast("decimal(38,10)"), digits).cast(f"decimal(38,{digits})").cast("string")
    return F.when(p < 2.0**52, text).otherwise(exact)


def flag(c: Column) -> Column:
    return F.when(c, "true").otherwise("false")


def _texts(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*(number(F.col(c)).alias(c) if kinds[c] == "double" else flag(F.col(c)).alias(c) if kinds[c] == "boolean" else F.col(c) for c in df.columns))


def write_csv(df: DataFrame, path: str, every_field_quoted: bool = False) -> None:
    """CSV with a header in one part; quotes where needed, or around every field."""
    _texts(df).coalesce(1).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=every_field_quoted, emptyValue="", nullValue="")


def write_reports(rows: DataFrame, folder: str) -> None:
    """summary, per_image and errors of `evaluate.compared` rows."""
    write_csv(summary_lines(evaluate.summary(rows)), f"{folder}/summary.csv")
    write_csv(evaluate.per_image(rows).orderBy("filename"), f"{folder}/per_image.csv")
    write_csv(evaluate.errors(rows).orderBy("filename"), f"{folder}/errors.csv")


def summary_lines(one: DataFrame) -> DataFrame:
    """The summary as (metric, value) lines of text: counts as whole numbers, the others with 4 digits."""
    kinds = dict(one.dtypes)
    return one.unpivot([], [(number(F.col(c)) if kinds[c] == "double" else F.col(c).cast("string")).alias(c) for c in one.columns], "metric", "value")


def write_timings(steps: DataFrame, path: str) -> None:
    """step,ms of one image's steps (array of struct name, ms), in order."""
    rows = steps.select(F.posexplode("steps").alias("i", "s")).orderBy("i").select(F.col("s.name").alias("step"), number(F.col("s.ms")).alias("ms"))
    rows.coalesce(1).write.mode("overwrite").csv(path, header=True, quoteAll=True)


def write_annotations(rows: DataFrame, path: str) -> None:
    """{"items": [...]}, as one text file; annotations of one folder of images, so one document holds them."""
    item = F.struct(*(F.col(c) for c in ANNOTATION))
    doc = rows.agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("items")), {"pretty": "true"}).alias("value"))
    doc.write.mode("overwrite").text(path)


def _open_store(uri: str):  # noqa: ANN202 - (pyarrow file system, path)
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", uri) if "://" in uri else os.path.abspath(uri))


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes each row's data (text or bytes) to the file `path` below a folder that all executors share; returns their number.

    A file is written under a name of its own and then moved, so that a repeated task leaves whole files only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open_store(folder)
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                target = f"{root.rstrip('/')}/{path}"
                store.create_dir(target.rpartition("/")[0], recursive=True)
                with store.open_output_stream(part := f"{target}.{uuid.uuid4().hex}", compression=None) as out:
                    out.write(data)
                store.move(part, target)
            yield pa.record_batch([pa.array([b.num_rows], pa.int64())], ["n"])

    return rows.select("path", F.col("data").cast("binary").alias("data")).mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_labels(rows: DataFrame, folder: str, names: list[str]) -> dict:
    """labels/<split>/<stem>.txt per image (rows of yolo_labels with split), dataset.yaml and summary.json; returns the summary."""
    lines = etl.label_lines(rows).join(rows.select("image", "split").distinct(), "image")
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    text = F.when(F.col("lines") == "", "").otherwise(F.concat("lines", F.lit("\n")))
    write_files(lines.select(F.concat(F.lit("labels/"), "split", F.lit("/"), stem, F.lit(".txt")).alias("path"), text.alias("data")), folder)
    counts = {r.split: r.n for r in rows.groupBy("split").agg(F.countDistinct("image").alias("n")).collect()}
    summary = {"images_total": sum(counts.values()), "annotations_total": rows.where("cls is not null").count(), "class_names": names, "splits": {"train": counts.get("train", 0), "val": counts.get("val", 0)}}
    extra = [("dataset.yaml", dataset_yaml(names)), ("summary.json", json.dumps(summary, indent=2))]
    write_files(rows.sparkSession.createDataFrame(extra, "path string, data string"), folder)
    return summary


def dataset_yaml(names: list[str]) -> str:
    """The text of a dataset's description."""
    return "\n".join(["path: .", "train: images/train", "val: images/val", f"names: {names}", ""])


def place_file(source: str, target: str, copy: bool = False) -> None:
    """Puts a local file at target by a hard link, or a copy where asked for or needed; a file that is there stays."""
    if os.path.exists(target):
        return
    os.makedirs(os.path.dirname(target), exist_ok=True)
    try:
        if copy:
            raise OSError
        os.link(source, target)
    except OSError:
        shutil.copy2(source, target)


def preprocess_report(rows: DataFrame) -> DataFrame:
    """(image, value): text lines for each prepared image (image, output, found, steps)."""
    steps = F.transform("steps", lambda s: F.concat(F.lit("  "), s["name"], F.lit(": "), number(s["ms"]), F.lit(" ms")))
    head = F.array(F.concat(F.lit("image: "), "image"), F.concat(F.lit("output: "), "output"), F.concat(F.lit("maskFound: "), flag(F.col("found"))), F.lit("timings:"))
    return rows.select("image", F.explode(F.concat(head, steps, F.array(F.lit("")))).alias("value"))


_MARK = "\ue000"  # around numbers that are already text, until they stand in the document


def _shown(c: Column, kind: T.DataType) -> Column:
    """A value as it is written: numbers with 4 digits, boxes as 'x,y,w,h' at any depth."""
    if isinstance(kind, T.DoubleType):
        return F.concat(F.lit(_MARK), number(c), F.lit(_MARK))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _shown(x, kind.elementType))
    if isinstance(kind, T.StructType):
        if kind.names == list("xywh"):
            return F.when(c.isNotNull(), F.concat_ws(",", *(c[k] for k in "xywh")))
        return F.when(c.isNotNull(), F.struct(*(_shown(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return c


def result_json(rows: DataFrame, pretty: bool = False) -> DataFrame:
    """Rows as JSON documents (value), nested structs and arrays included; numbers have 4 digits, boxes are 'x,y,w,h'."""
    cols = [_shown(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema.fields]
    text = F.to_json(F.struct(*cols), {"pretty": str(pretty).lower(), "ignoreNullFields": "false"})
    return rows.select(F.regexp_replace(text, f'"{_MARK}([^"{_MARK}]*){_MARK}"', "$1").alias("value"))


def write_candidates(rows: DataFrame, path: str) -> None:
    """The recognition report: 14 columns of `select.report` rows, texts in quotes."""
    quoted = {"roi_id", "variant", "psm", "status", "text", "normalized"}
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) if c in quoted else F.col(c).cast("string") for c in _texts(rows).columns]
    lines = _texts(rows).select(F.concat_ws(",", *cells).alias("value"), F.monotonically_increasing_id().alias("_line"))
    head = rows.sparkSession.createDataFrame([(",".join(rows.columns), -1)], "value string, _line long")
    head.unionByName(lines).coalesce(1).sortWithinPartitions("_line").select("value").write.mode("overwrite").text(path)


def write_detections(summary: DataFrame, every: DataFrame, folder: str) -> None:
    """detections_summary and detections_all of `etl.detection_rows`; boxes are 'a,b,c,d'."""
    for df, name in ((summary, "detections_summary"), (every, "detections_all")):
        write_csv(df.select(*(F.array_join(c, ",").alias(c) if kind == "array<int>" else F.col(c) for c, kind in df.dtypes)), f"{folder}/{name}.csv")
    write_json_array(summary, f"{folder}/detections_summary.json")


def write_json_array(rows: DataFrame, path: str) -> None:
    """All rows as one JSON array in one file; for reports, which are small."""
    rows.agg(F.to_json(F.collect_list(F.struct(*rows.columns)), {"pretty": "true"}).alias("value")).write.mode("overwrite").text(path)


def wheel_report(rows: DataFrame) -> DataFrame:
    """Text lines of a wheel's geometry: (image, value)."""
    lines = F.array(F.concat(F.lit("found: "), flag(F.col("found"))), *(F.concat(F.lit(f"{n}: "), number(F.col(n))) for n in ("center_x", "center_y", "inner_radius", "outer_radius")))
    return rows.select("image", F.explode(lines).alias("value"))


def write_training_export(rows: DataFrame, existing: DataFrame, folder: str) -> None:
    """annotations.csv, size_crops.csv, dot_crops.csv and the crops themselves below a folder; existing: (path, content) of previews."""
    manifest, *crops = training_export(rows, existing.select("path"))
    write_csv(manifest, f"{folder}/annotations.csv")
    for df, field in zip(crops, ("size", "dot"), strict=True):
        write_csv(df, f"{folder}/{field}_crops.csv")
        previews = rows.select("image", F.col(f"{field}PreviewPath").alias("path"))
        write_files(df.select("image", "crop").join(previews, "image").join(existing, "path").select(F.col("crop").alias("path"), F.col("content").alias("data")), folder)


def training_export(rows: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotations, size crops, dot crops) of annotation rows (with annotation_image); existing: (path) of previews that are there."""
    manifest = rows.select("image", "sizeStartAngleDeg", "sizeEndAngleDeg", "sizePreviewPath", "sizeText", "sizeVisible", "dotStartAngleDeg", "dotEndAngleDeg", "dotPreviewPath", "dotText", "dotVisible", "dotDateVisible", "dot4Text")
    name = F.regexp_replace(F.regexp_extract("image", r"([^/\\]*)$", 1), r"\.[^.]*$", "")

    def crops(field: str, columns: list[str]) -> DataFrame:
        there = rows.where(F.col(f"{field}PreviewPath") != "").join(existing, rows[f"{field}PreviewPath"] == existing["path"], "left_semi")
        return there.select("image", "annotation_image", F.concat(F.lit(f"{field}_crops/"), name, F.lit(f"_{field}.png")).alias("crop"), *columns)

    return manifest, crops("size", ["sizeStartAngleDeg", "sizeEndAngleDeg", "sizeText", "sizeVisible"]), crops("dot", ["dotStartAngleDeg", "dotEndAngleDeg", "dotText", "dotVisible", "dotDateVisible", "dot4Text"])
