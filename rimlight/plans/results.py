"""Evaluation of programs' answers in files against a ground-truth file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimlight.functions import text as t
from rimlight.plans import evaluate
from rimlight.sources import files


def results_of(answers: DataFrame) -> DataFrame:
    """The evaluation's columns from analysis answers (`payloads` rows); the file name is the image."""
    p = F.col("p")

    def number(c):  # noqa: ANN001, ANN202
        return F.coalesce(c, F.lit(0.0))

    def flag(c):  # noqa: ANN001, ANN202
        return F.coalesce(c, F.lit(False))

    return answers.where("status = 'ok'").select(
        t.file_name(p["inputPath"]).alias("image"), t.blank(p["tyreSize"]["normalized"]).alias("size"), number(p["tyreSize"]["confidence"]).alias("size_conf"), number(p["tyreSize"]["roiQuality"]).alias("size_quality"),
        flag(p["tyreSizeFound"]).alias("size_found"), t.blank(p["dot"]["normalized"]).alias("dot"), number(p["dot"]["confidence"]).alias("dot_conf"), number(p["dot"]["roiQuality"]).alias("dot_quality"),
        flag(p["dotFound"]).alias("dot_found"), t.blank(p["dotWeekYear"]).alias("week_year"), t.blank(p["dotFullNormalized"]).alias("full_normalized"), flag(p["dotWeekYearFound"]).alias("week_year_found"),
        flag(p["dotFullFound"]).alias("full"), number(p["timings"]["totalMs"]).alias("total_ms"),
    )


def report(spark: SparkSession, expected_csv: str, answers_path: str) -> DataFrame:
    """`evaluate.compared` rows for answers in JSON lines."""
    return compared(spark, expected_csv, spark.read.text(answers_path))


def compared(spark: SparkSession, expected_csv: str, answers: DataFrame) -> DataFrame:
    """`evaluate.compared` rows for answers (value: JSON)."""
    truth = files.expected(spark, expected_csv).select(F.col("filename").alias("image"), "expected_size", "expected_dot4", F.col("expected_dot_full").alias("expected_full"), "brand", "model", "difficulty", "notes", F.lit(1).alias("rank"))
    return evaluate.compared(results_of(files.payloads(answers)), truth)
