"""The evaluation of readings against ground truth: scores, winners, flags, reasons and the three reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rimlight.functions import text as t
from rimlight.operators import select
from rimlight.plans.inputs import derived

KEYS = ["image", "field"]


def scored(ocr: DataFrame) -> DataFrame:
    """Candidates with what the parsers find and the two confidences: of strips (conf) and of single regions (score).

    Each text is parsed once, as what its field needs; what only the other field has is null, false or blank.
    """
    is_size = F.col("field") == "size"
    rows = ocr.withColumns({"ocr": F.col("conf"), "size": F.when(is_size, t.parse_size(F.col("text"))), "dot": F.when(~is_size, t.parse_dot(F.col("text")))})
    dot = F.col("dot")
    done = F.when(dot["full"], 1.0).when(dot["week_year_found"], 0.78).when(dot["found"], 0.55).otherwise(0.0)
    strip = F.when(is_size, 0.50 * F.col("ocr") + 0.35 * F.col("size.quality") + 0.15 * F.col("quality")).otherwise(0.45 * F.col("ocr") + 0.35 * done + 0.20 * F.col("quality"))
    region = F.when(is_size, 0.55 * F.col("ocr") + 0.45 * F.col("size.quality")).otherwise(0.55 * F.col("ocr") + 0.45 * done)
    found = F.when(is_size, F.col("size.found")).otherwise(dot["found"])
    return rows.select(
        "image", "field", "seq", "text", "ocr", "quality", found.alias("found"), F.coalesce(dot["week_year_found"], F.lit(False)).alias("week_year_found"), F.coalesce(dot["full"], F.lit(False)).alias("full"),
        F.when(is_size, F.col("size.normalized")).otherwise(dot["normalized"]).alias("normalized"), dot["full_normalized"].alias("full_normalized"), dot["week_year"].alias("week_year"),
        F.when(found, t.clamp01(strip)).otherwise(0.0).alias("conf"), t.clamp01(region).alias("score"),
        F.when(is_size, F.col("size.found")).otherwise(dot["full"]).alias("ok"),
    )


def results(rows: DataFrame) -> DataFrame:
    """One row per image with the winning readings of both fields; missing readings are blank and 0.

    Both winners are aggregates of one grouping, and the cut of the dot field is a window over the same key, so that the
    candidates are shuffled once.
    """
    c, whole = F.col, Window.partitionBy("image")
    live = c("found") & (c("conf") > 0)
    is_dot = live & (c("field") == "dot")
    rows = rows.drop("text", "ocr", "score", "ok")
    rows = rows.withColumn("_cut", F.min(F.when(is_dot & c("week_year_found") & (c("conf") >= select.DOT_STOP), c("seq"))).over(whole))
    size_on, dot_on = live & (c("field") == "size"), is_dot & (c("_cut").isNull() | (c("seq") <= c("_cut")))
    size = F.min_by(F.struct(c("normalized").alias("size"), c("conf").alias("size_conf"), c("quality").alias("size_quality")), F.when(size_on, select.size_order(c("conf"), c("seq"))))
    dot = F.min_by(
        F.struct(c("normalized").alias("dot"), c("conf").alias("dot_conf"), c("quality").alias("dot_quality"), "week_year", "full_normalized", "week_year_found", "full"),
        F.when(dot_on, F.struct(-c("conf"), c("seq"))),
    )
    out = rows.groupBy("image").agg((F.count("*") * 7.5 + F.sum("seq")).alias("total_ms"), size.alias("_s"), dot.alias("_d"))
    out = out.select("image", "total_ms", c("_s").isNotNull().alias("size_found"), "_s.*", c("_d").isNotNull().alias("dot_found"), "_d.*")
    return out.na.fill("", ["size", "dot", "week_year", "full_normalized"]).na.fill(0.0, ["size_conf", "dot_conf", "size_quality", "dot_quality"]).na.fill(False, ["week_year_found", "full"])


def reason(r: Column | None = None) -> Column:
    """Why a row may be wrong: the first that applies, for every row."""
    c = F.col
    return (
        F.when(~c("size_found") & ~c("dot_found"), "roi_not_found")
        .when((c("size_found") & (c("size_conf") < 0.35)) | (c("dot_found") & (c("dot_conf") < 0.35)), "weak_ocr")
        .when((c("expected_dot4") != "") & c("week_year_found") & ~c("full"), "partial_dot_only")
        .when(((c("expected_size") != "") & c("size_found") & ~c("size_match")) | ((c("expected_dot4") != "") & c("dot_found") & ~c("dot4_match")), "parse_failure")
        .when((c("size_quality") < 0.30) | (c("dot_quality") < 0.30), "image_quality_issue")
        .otherwise("unknown")
    )


def compared(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Readings of images with ground truth (its last row per image), with match flags and reasons; blank equals blank."""
    truth = select.last_wins(expected, ["image"], ["rank"])

    def same(a: str, b: str) -> Column:
        return t.key(F.col(a)) == t.key(F.col(b))

    rows = found.join(truth, "image")
    rows = rows.withColumns({"size_match": same("expected_size", "size"), "dot4_match": same("expected_dot4", "week_year"), "full_match": same("expected_full", "full_normalized")})
    return rows.withColumn("reason", reason())


def summary(rows: DataFrame) -> DataFrame:
    """One row of counts, means and percentiles; 0 where there is no image."""

    def mean(c: str) -> Column:
        return F.coalesce(F.avg(c), F.lit(0.0))

    return rows.agg(
        F.count("*").alias("totalImages"), F.count_if("size_found").alias("sizeDetectedCount"), F.count_if("size_match").alias("sizeExactMatchCount"), F.count_if("dot_found").alias("dotDetectedCount"),
        F.count_if("dot4_match").alias("dot4MatchCount"), F.count_if("full_match").alias("dotFullMatchCount"), mean("size_conf").alias("avgSizeConfidence"), mean("dot_conf").alias("avgDotConfidence"),
        mean("total_ms").alias("avgTotalMs"), F.coalesce(F.percentile("total_ms", F.lit(0.5)), F.lit(0.0)).alias("p50TotalMs"), F.coalesce(F.percentile("total_ms", F.lit(0.9)), F.lit(0.0)).alias("p90TotalMs"), F.coalesce(F.max("total_ms"), F.lit(0.0)).alias("maxTotalMs"),
    )


def metrics(one: DataFrame) -> DataFrame:
    """The summary as (metric, value) lines."""
    return one.unpivot([], [F.col(c).cast("double").alias(c) for c in one.columns], "metric", "value")


# The reports' columns, and what each holds here.
PER_IMAGE = {
    "filename": "image", "expected_size": "expected_size", "predicted_size": "size", "expected_dot4": "expected_dot4", "predicted_dot4": "week_year", "expected_dot_full": "expected_full", "predicted_dot_full": "full_normalized",
    "size_found": "size_found", "size_confidence": "size_conf", "dot_found": "dot_found", "dot_confidence": "dot_conf", "total_ms": "total_ms", "size_exact_match": "size_match", "dot4_match": "dot4_match",
    "dot_full_match": "full_match", "suspected_reason": "reason", "brand": "brand", "model": "model", "difficulty": "difficulty", "notes": "notes",
}
ERRORS = ("filename", "expected_size", "predicted_size", "expected_dot4", "predicted_dot4", "expected_dot_full", "predicted_dot_full", "size_confidence", "dot_confidence", "total_ms", "suspected_reason")


def per_image(rows: DataFrame) -> DataFrame:
    """One line per compared image."""
    return rows.select(*((F.col(old).cast("string") if new == "filename" else F.col(old)).alias(new) for new, old in PER_IMAGE.items()))


def errors(rows: DataFrame) -> DataFrame:
    """All rows but those right in size and DOT4 and, where it is expected, in the full DOT."""
    return per_image(rows.where(~(F.col("size_match") & F.col("dot4_match") & ((F.col("expected_full") == "") | F.col("full_match"))))).select(*ERRORS)


def evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(results(scored(derived(spark, sf_dir, "ocr"))), derived(spark, sf_dir, "expected"))
