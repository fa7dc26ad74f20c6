"""Readers of the programs' files as DataFrames. Blank means missing: text columns are never null."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rimlight.functions import geometry as g
from rimlight.functions import text as t
from rimlight.operators.select import last_wins

EXPECTED = ("filename", "expected_size", "expected_dot4", "expected_dot_full", "brand", "model", "difficulty", "notes")
SUGGESTIONS = ("image", "size_base_guess", "size_full_guess", "size_confidence", "size_location_hint", "dot_text_guess", "dot4_guess", "dot_confidence", "dot_location_hint", "review_status", "notes")
FIELD = "struct<raw:string,normalized:string,found:boolean,confidence:double,uncertainty:double,roiQuality:double,cropPath:string,boundingBox:string>"
RESULT = (
    f"inputPath string, frameId string, wheelFound boolean, wheelCenterX double, wheelCenterY double, wheelInnerRadius double, wheelOuterRadius double, tyreSize {FIELD}, dot {FIELD}, "
    "tyreSizeFound boolean, dotFound boolean, dotKeywordFound boolean, dotCodeBodyFound boolean, dotWeekYearFound boolean, dotFullFound boolean, dotWeekYear string, dotFullRaw string, dotFullNormalized string, "
    "overlayPath string, yoloOverlayPath string, debugDir string, timingReportPath string, ocrReportPath string, "
    "yoloDetections array<struct<label:string,confidence:double,acceptedForOcr:boolean,boundingBox:string>>, notes array<string>, "
    "timings struct<preprocessMs:double,roiProposalMs:double,ocrMs:double,parsingMs:double,cropSaveMs:double,overlaySaveMs:double,totalMs:double>, "
    "stepTimings array<struct<name:string,ms:double>>, error string"
)
ROI = "imagePath string, branch string, roi string, rawText string, normalizedText string, found boolean, confidence double, cropPath string, notes array<string>, stepTimings array<struct<name:string,ms:double>>, error string"
SECTOR = "imagePath string, branch string, startAngleDeg double, endAngleDeg double, wheelFound boolean, wheelCenterX double, wheelCenterY double, wheelInnerRadius double, wheelOuterRadius double, overlayPath string, unwrappedPath string, notes array<string>, stepTimings array<struct<name:string,ms:double>>, error string"
COCO = "images array<struct<id:bigint,file_name:string,width:int,height:int>>, categories array<struct<id:bigint,name:string>>, annotations array<struct<image_id:bigint,category_id:bigint,bbox:array<double>>>"
#: Field of an annotation: type and default.
ANNOTATION = {
    "image": ("string", ""), "sizeStartAngleDeg": ("double", 0.0), "sizeEndAngleDeg": ("double", 0.0), "sizeSectorSet": ("boolean", False), "sizeCropTopPercent": ("int", 0), "sizeCropBottomPercent": ("int", 100),
    "dotStartAngleDeg": ("double", 0.0), "dotEndAngleDeg": ("double", 0.0), "dotSectorSet": ("boolean", False), "dotCropTopPercent": ("int", 0), "dotCropBottomPercent": ("int", 100),
    "sizePreviewPath": ("string", ""), "dotPreviewPath": ("string", ""), "sizeText": ("string", ""), "dotText": ("string", ""), "dot4Text": ("string", ""),
    "sizeVisible": ("boolean", True), "dotVisible": ("boolean", True), "dotDateVisible": ("boolean", False), "wheelOverrideSet": ("boolean", False),
    "wheelCenterX": ("double", 0.0), "wheelCenterY": ("double", 0.0), "wheelInnerRadius": ("double", 0.0), "wheelOuterRadius": ("double", 0.0),
}


def images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded images of a flat folder in order of path; unreadable ones have height -1 and a note."""
    rows = spark.read.format("image").option("dropInvalid", False).load(folder).select("image.*")
    rows = rows.where(t.is_image(F.col("origin"))).orderBy("origin")
    return rows.withColumn("note", F.when(F.col("height") < 0, "Unable to read input image.").otherwise(""))


def image_files(spark: SparkSession, folders: dict[str, str] | str) -> DataFrame:
    """(dataset, path, length, modificationTime, content) of supported files in each folder, not below it."""
    parts = {os.path.basename(folders.rstrip("/")): folders} if isinstance(folders, str) else folders
    out = None
    for name, folder in parts.items():
        df = spark.read.format("binaryFile").load(folder).where(t.is_image(F.col("path"))).select(F.lit(name).alias("dataset"), "*")
        out = df if out is None else out.unionByName(df)
    return out.orderBy("dataset", "path")


def dataset_folder(spark: SparkSession, root: str) -> str:
    """A dataset's images/ if there is one, else its train/."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for name in ("images", "train"):
        path = jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        if path.getFileSystem(conf).exists(path):
            return f"{root.rstrip('/')}/{name}"
    raise FileNotFoundError(f"{root} has neither images nor train")


def csv_fields(line: Column) -> Column:
    """The fields of a CSV line; a quote toggles wherever it stands, and a doubled one inside quotes is itself.

    A field is what lies between commas outside quotes; quotes that aren't closed reach to the line's end.
    """
    quoted = '"((?:[^"]++|"")*+)(?:"|$)'
    raw = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(f',((?:[^",]++|{quoted.replace("(", "(?:", 1)})*+)'), F.lit(1))
    # without the quotes around its parts, all that are left in a field are doubled ones
    return F.transform(raw, lambda x: F.replace(F.regexp_replace(x, quoted, "$1"), F.lit('""'), F.lit('"')))


def csv_field(fields: Column, place: Column) -> Column:
    """A field by its place (from 1), trimmed; blank beyond the last."""
    return F.trim(F.coalesce(F.try_element_at(fields, place.cast("int")), F.lit("")))


#: What lines are in order by: their file, the part of it that a task reads, their place there.
ORDER = ["file", "block", "line"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines (value) of text files, with their order, however many files and tasks there are."""
    value = F.regexp_replace("value", "\r$", "").alias("value")
    return spark.read.text(path, lineSep="\n").select(value, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def expected(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth by position: each file's first line is skipped, as are blank lines and those with fewer than 8 fields; the last row of a file name counts."""
    lines = _lines(spark, path)
    heads = lines.where("block = 0").groupBy("file").agg(F.min("line").alias("_head"))
    rows = lines.join(F.broadcast(heads), "file")  # a row per file
    rows = rows.where("line != _head and value != ''").select(*ORDER, csv_fields(F.col("value")).alias("f")).where(F.size("f") >= len(EXPECTED))
    rows = rows.select(*ORDER, *(F.col("f")[i].alias(c) for i, c in enumerate(EXPECTED)))
    return last_wins(rows, ["filename"], ORDER).drop(*ORDER)


def suggestions(spark: SparkSession, path: str) -> DataFrame:
    """Suggestions by column name under the path key of their image (key); missing columns are blank, the last row of a key counts."""
    lines = _lines(spark, path)
    heads = lines.where("block = 0").groupBy("file").agg(F.min_by(csv_fields(F.col("value")), "line").alias("_names"), F.min("line").alias("_head"))
    rows = lines.join(F.broadcast(heads), "file").where("line != _head").withColumn("f", csv_fields(F.col("value")))  # a row per file
    names = F.transform("_names", F.trim)
    rows = rows.select(*ORDER, *(F.when(F.array_contains(names, c), csv_field(F.col("f"), F.array_position(names, c))).otherwise("").alias(c) for c in SUGGESTIONS))
    rows = rows.withColumn("key", t.path_key(F.col("image"))).where("key != ''")
    return last_wins(rows, ["key"], ORDER).drop(*ORDER)


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations with their defaults, under path keys; an item without an image is dropped, the last of a key counts."""
    item = ",".join(f"{name}:{kind}" for name, (kind, _) in ANNOTATION.items())
    rows = spark.read.schema(f"items array<struct<{item}>>").json(path, multiLine=True)
    rows = rows.select(F.posexplode("items").alias("line", "i")).select("line", *(F.coalesce(F.col(f"i.{n}"), F.lit(default)).alias(n) for n, (_, default) in ANNOTATION.items()))
    rows = rows.withColumn("image", t.path_key(F.col("image"))).where("image != ''")
    return last_wins(rows, ["image"], ["line"]).drop("line")


def coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(images, annotations, categories in use) of a COCO file, as tables for yolo_labels."""
    doc = spark.read.schema(COCO).json(path, multiLine=True)
    images = doc.select(F.inline("images")).select(F.col("id").alias("image"), "file_name", "width", "height")
    found = doc.select(F.posexplode("annotations").alias("idx", "a")).select("idx", F.col("a.image_id").alias("image"), F.col("a.category_id").alias("label"), F.struct(*(F.col("a.bbox")[i].alias(n) for i, n in enumerate("xywh"))).alias("box"))
    used = doc.select(F.inline("categories")).join(found.select(F.col("label").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("label"), "name")
    return images, found, used


def payloads(texts: DataFrame, column: str = "value", schema: str = RESULT) -> DataFrame:
    """Programs' JSON answers as rows: status is error where there is an error field or no JSON, else ok."""
    parsed = texts.withColumn("p", F.from_json(column, schema, {"mode": "PERMISSIVE"}))
    first = schema.split()[0]
    bad = F.col("p").isNull() | F.col(f"p.{first}").isNull() & F.col("p.error").isNull()
    return parsed.withColumn("status", F.when(bad | F.col("p.error").isNotNull(), "error").otherwise("ok")).withColumn("error", F.coalesce("p.error", F.when(bad, F.lit("unreadable answer")), F.lit("")))


def rois(texts: DataFrame, column: str = "value") -> DataFrame:
    """Answers for single regions, their 'x,y,w,h' as a box."""
    return payloads(texts, column, ROI).withColumn("box", g.parse_box(F.col("p.roi")))


def sectors(texts: DataFrame, column: str = "value") -> DataFrame:
    """Answers for unwrapped sectors."""
    return payloads(texts, column, SECTOR)


def program_rows(answers: DataFrame) -> DataFrame:
    """Flat result rows of `payloads` (dataset, image_path beside them): 24 columns, those of errors mostly null."""
    p, ok = F.col("p"), F.col("status") == "ok"

    def timing(name: str) -> Column:
        return F.coalesce(F.try_element_at(F.filter(p["stepTimings"], lambda s: s["name"] == name), F.lit(1))["ms"], F.lit(0.0))

    values = {
        "wheel_found": p["wheelFound"], "size_found": p["tyreSizeFound"], "size_raw": t.blank(p["tyreSize"]["raw"]), "size_normalized": t.blank(p["tyreSize"]["normalized"]), "size_confidence": F.coalesce(p["tyreSize"]["confidence"], F.lit(0.0)),
        "dot_found": p["dotFound"], "dot_week_year_found": p["dotWeekYearFound"], "dot_raw": t.blank(p["dot"]["raw"]), "dot_normalized": t.blank(p["dot"]["normalized"]), "dot_week_year": t.blank(p["dotWeekYear"]),
        "dot_confidence": F.coalesce(p["dot"]["confidence"], F.lit(0.0)), "total_ms": F.coalesce(p["timings"]["totalMs"], F.lit(0.0)),
    } | {n: timing(n) for n in ("wheel_total_ms", "wheel_unwrap_total_ms", "yolo_inference_ms", "size_branch_total_ms", "dot_branch_total_ms")} | {
        "size_crop_path": t.blank(p["tyreSize"]["cropPath"]), "dot_crop_path": t.blank(p["dot"]["cropPath"]), "notes": F.array_join(F.coalesce(p["notes"], F.array().cast("array<string>")), " | "),
    }
    for name in ("wheel_found", "size_found", "dot_found", "dot_week_year_found"):
        values[name] = F.coalesce(values[name], F.lit(False))
    return answers.select("dataset", "image_path", "status", *(F.when(ok, v).alias(k) for k, v in values.items()), F.when(~ok, F.col("error")).alias("error"))


OCR_SCHEMA = T.StructType([T.StructField(n, k) for n, k in (("branch", T.StringType()), ("roi_id", T.StringType()), ("variant", T.StringType()), ("psm", T.StringType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("elapsed_ms", T.DoubleType()), ("ocr_conf", T.DoubleType()), ("regex_valid", T.BooleanType()), ("domain_score", T.DoubleType()), ("final_score", T.DoubleType()), ("status", T.StringType()), ("text", T.StringType()), ("normalized", T.StringType()))])


def ocr_candidates(spark: SparkSession, path: str) -> DataFrame:
    """The candidates that a recognizer has written, 14 columns; blanks stay blank."""
    return spark.read.schema(OCR_SCHEMA).csv(path, header=True, escape='"').na.fill("", ["text", "normalized"])
