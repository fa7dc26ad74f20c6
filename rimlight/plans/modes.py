"""What the command line's image modes compute: rows in the answers' fields, and the rasters that go with them as files.

Recognition is the caller's: `read` takes (variants, field) to readings, as a provider's read does; without it nothing
is recognized and a note says so.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimlight.functions import pixels
from rimlight.functions import text as t
from rimlight.operators import select
from rimlight.plans import evaluate

Read = Callable[[DataFrame, str], DataFrame]
NO_READER = "No text recognizer is set."
NO_WHEEL = "Wheel geometry was not found."
_TIMINGS = "array<struct<name:string,ms:double>>"
_WHEEL = {"wheelFound": "found", "wheelCenterX": "center_x", "wheelCenterY": "center_y", "wheelInnerRadius": "inner_radius", "wheelOuterRadius": "outer_radius"}


def _stem(c: str = "origin") -> Column:
    return t.safe_stem(t.step_name(F.col(c)), "image")


def _notes(*notes: Column) -> Column:
    return F.array_compact(F.array(*notes)).cast("array<string>").alias("notes")


def _common(first: str) -> list[Column]:
    return [F.col("origin").alias(first)]


def wheels(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(answers, files): each image's wheel, and its unwrapped band as path and data."""

    def kernel(a):  # noqa: ANN001, ANN202
        found, *ring = pixels.combined_wheel(a)
        return [(found, *ring, pixels.pgm(pixels.unwrap(a, *ring)) if found else None)]

    rows = pixels.over_images(images, kernel, "found boolean, center_x double, center_y double, inner_radius double, outer_radius double, band binary")
    path = F.when(F.col("found"), F.concat(_stem(), F.lit("/unwrapped_band.pgm"))).otherwise("")
    answers = rows.select(*_common("inputPath"), _stem().alias("frameId"), *(F.col(old).alias(new) for new, old in _WHEEL.items()), path.alias("unwrappedBandPath"), _notes(F.when(~F.col("found"), NO_WHEEL)), F.array().cast(_TIMINGS).alias("stepTimings"))
    return answers, rows.where("found").select(path.alias("path"), F.col("band").alias("data"))


def sectors(images: DataFrame, start: float, end: float, branch: str, wheel: tuple[float, float, float, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, files): the part of each image's unwrapped band between two angles; wheel (center, radii) replaces the detected one."""

    def kernel(a):  # noqa: ANN001, ANN202
        found, *ring = (True, *wheel) if wheel else pixels.combined_wheel(a)
        part = pixels.sector(pixels.unwrap(a, *ring), start, end) if found else None
        return [(found, *(float(x) for x in ring), pixels.pgm(part) if part is not None and part.size else None)]

    rows = pixels.over_images(images, kernel, "found boolean, center_x double, center_y double, inner_radius double, outer_radius double, part binary")
    path = F.when(F.col("part").isNotNull(), F.concat(_stem(), F.lit(f"/{branch}_sector.pgm"))).otherwise("")
    answers = rows.select(*_common("imagePath"), F.lit(branch).alias("branch"), F.lit(float(start)).alias("startAngleDeg"), F.lit(float(end)).alias("endAngleDeg"), *(F.col(old).alias(new) for new, old in _WHEEL.items()), path.alias("unwrappedPath"), _notes(F.when(F.col("part").isNull(), NO_WHEEL)), F.array().cast(_TIMINGS).alias("stepTimings"))
    return answers, rows.where("part is not null").select(path.alias("path"), F.col("part").alias("data"))


def _won(readings: DataFrame, quality: Column) -> DataFrame:
    """The winning reading of each image among a region's: image, raw, normalized, found, score and what a DOT has."""
    rows = evaluate.scored(readings.withColumn("quality", quality))
    return select.roi_winner(rows, ["image", "field"]).select("image", "field", "text", "normalized", "found", "score", "full", "full_normalized", "week_year", "week_year_found")


def regions(images: DataFrame, box: tuple[int, int, int, int], branch: str, read: Read | None = None) -> tuple[DataFrame, DataFrame]:
    """(answers, files): what is read in one box of each image."""
    x, y, w, h = box

    def forms(a):  # noqa: ANN001, ANN202
        part = pixels.crop(a, x, y, w, h)
        return [(-1, "crop", *part.shape, pixels.pgm(part))] + [(i, n, *v.shape, v.tobytes()) for i, (n, v) in enumerate(pixels.variants(part, branch == "dot"))]

    rows = pixels.over_images(images, forms, "seq int, variant string, height int, width int, data binary")
    path = F.concat(_stem(), F.lit(f"/{branch}_roi.pgm"))
    crops = rows.where("seq < 0").select("origin", path.alias("path"), "data")
    base = crops.select(*_common("imagePath"), F.lit(branch).alias("branch"), F.lit(",".join(map(str, box))).alias("roi"), F.col("path").alias("cropPath"))
    if read is None:
        base = base.withColumns({"rawText": F.lit(""), "normalizedText": F.lit(""), "found": F.lit(False), "confidence": F.lit(0.0), "notes": F.array(F.lit(NO_READER))})
    else:
        won = _won(read(rows.where("seq >= 0"), branch), F.lit(0.0)).select(F.col("image").alias("imagePath"), F.col("text").alias("rawText"), F.col("normalized").alias("normalizedText"), F.col("found"), F.col("score").alias("confidence"))
        base = base.join(won, "imagePath", "left").na.fill("", ["rawText", "normalizedText"]).na.fill(0.0, ["confidence"]).na.fill(False, ["found"]).withColumn("notes", F.array().cast("array<string>"))
    order = ["imagePath", "branch", "roi", "rawText", "normalizedText", "found", "confidence", "cropPath", "notes"]
    return base.select(*order, F.array().cast(_TIMINGS).alias("stepTimings")), crops.select("path", "data")


def analyses(images: DataFrame, read: Read | None = None) -> DataFrame:
    """Each image's answer: its wheel, and what both fields' recognition of the whole image gives; unreadable images have a note only."""
    found = pixels.wheels(images)
    rows = images.select("origin", "note").join(found, "origin", "left")
    fields = {}
    for field in ("size", "dot"):
        if read is not None:
            won = _won(read(pixels.all_variants(images, field == "dot"), field), F.lit(0.0))
            rows = rows.join(won.select(F.col("image").alias("origin"), F.struct(*won.columns[2:]).alias(field)), "origin", "left")
        else:
            rows = rows.withColumn(field, F.lit(None).cast("struct<text:string,normalized:string,found:boolean,score:double,full:boolean,full_normalized:string,week_year:string,week_year_found:boolean>"))
        r, ok = F.col(field), F.coalesce(F.col(f"{field}.found"), F.lit(False))
        fields[field] = F.struct(t.blank(F.when(ok, r["text"])).alias("raw"), t.blank(F.when(ok, r["normalized"])).alias("normalized"), ok.alias("found"), F.coalesce(F.when(ok, r["score"]), F.lit(0.0)).alias("confidence"), F.lit(0.0).alias("roiQuality"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    notes = _notes(F.nullif("note", F.lit("")), F.when((F.col("note") == "") & ~flag("found"), NO_WHEEL), F.lit(NO_READER) if read is None else F.lit(None))
    wheel = [F.coalesce(F.col(old), F.lit(False) if old == "found" else F.lit(0.0)).alias(new) for new, old in _WHEEL.items()]
    return rows.select(
        *_common("inputPath"), _stem().alias("frameId"), *wheel, fields["size"].alias("tyreSize"), fields["dot"].alias("dot"), flag("size.found").alias("tyreSizeFound"), flag("dot.found").alias("dotFound"),
        flag("dot.week_year_found").alias("dotWeekYearFound"), flag("dot.full").alias("dotFullFound"), t.blank(F.col("dot.week_year")).alias("dotWeekYear"), t.blank(F.col("dot.full_normalized")).alias("dotFullNormalized"), notes,
    )
