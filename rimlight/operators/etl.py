"""Joins and reshapings between the tables of the batch programs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimlight.functions import text as t
from rimlight.functions.geometry import expand_corners, to_yolo
from rimlight.operators.select import last_wins


def best_per_label(detections: DataFrame, keys: Sequence[str] = ("image",)) -> DataFrame:
    """Per image and label the most confident detection, the first of equals."""
    one = F.min_by(F.struct(*detections.columns), F.struct(-F.col("conf"), "idx"))
    return detections.groupBy(*keys, "label").agg(one.alias("_b")).select("_b.*")


def category_index(categories: DataFrame, column: str) -> DataFrame:
    """(column, cls): the categories in use, numbered from 0 in order; there are as many rows as names."""
    return categories.select(column).where(F.col(column).isNotNull()).distinct().withColumn("cls", (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))


def yolo_labels(images: DataFrame, annotations: DataFrame, categories: DataFrame) -> DataFrame:
    """Images (image, file_name, width, height) with each annotation's class and normalized box (yolo); images without any stay."""
    rows = images.join(annotations, "image", "left").join(categories, "label", "left")
    return rows.withColumn("yolo", to_yolo(F.col("box"), F.col("width"), F.col("height")))


def label_lines(rows: DataFrame) -> DataFrame:
    """(image, file_name, lines): a label file's text per image, in the order of the annotations' idx where there is one."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "cls", "yolo.cx", "yolo.cy", "yolo.w", "yolo.h")
    order = F.col("idx") if "idx" in rows.columns else F.monotonically_increasing_id()
    grouped = rows.groupBy("image", "file_name").agg(F.array_sort(F.collect_list(F.when(F.col("cls").isNotNull(), F.struct(order.alias("o"), line.alias("l"))))).alias("_l"))
    return grouped.select("image", "file_name", F.array_join(F.transform("_l", lambda s: s["l"]), "\n").alias("lines"))


def split(images: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """images with split: a seeded share of at least one image is 'val', the rest 'train'.

    The share is exact: hashes are counted in 1,024 classes first, and only the class where the share ends is ordered.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    rows = images.withColumn("_h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")).withColumn("_c", F.shiftright("_h", 50))
    sums = rows.groupBy("_c").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    sums = sums.select("_c", (upto - F.col("_n")).alias("_before"), F.greatest(F.lit(1), F.bround(total * fraction).cast("long")).alias("_want"))
    rows = rows.join(F.broadcast(sums), "_c")  # 1,024 rows at most
    rank = F.row_number().over(Window.partitionBy("_c").orderBy("_h", key))
    return rows.withColumn("split", F.when(F.col("_before") + rank <= F.col("_want"), "val").otherwise("train")).drop("_h", "_c", "_before", "_want")


def dot_reading(text: Column, week_year: Column) -> Column:
    """Whether a DOT reading counts: a text or a week and year was found."""
    return (t.blank(text) != "") | (t.blank(week_year) != "")


def preferred(engines: Sequence[tuple[Column, str, Column, Column]]) -> Column:
    """struct(text, engine, confidence) of the first engine whose reading parsed; blank and 0 if none did."""

    def one(text: Column, engine: Column, confidence: Column) -> Column:
        return F.struct(text.cast("string").alias("text"), engine.alias("engine"), confidence.cast("double").alias("confidence"))

    out = one(F.lit(""), F.lit(""), F.lit(0.0))
    for ok, name, text, confidence in reversed(engines):
        out = F.when(ok, one(text, F.lit(name), confidence)).otherwise(out)
    return out


def merge_texts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, text (all in order, squeezed), conf (mean) and best (the most confident that isn't blank, the last of equals)."""
    some = F.col("text") != ""
    every = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda s: s["text"]), " ")
    best = F.max_by(F.when(some, F.col("text")), F.when(some, F.struct("conf", "seq")))
    return rows.groupBy(*keys).agg(t.squeeze_unicode(every).alias("text"), F.coalesce(F.avg("conf"), F.lit(0.0)).alias("conf"), best.alias("best"))


def suggested(images: DataFrame, guesses: DataFrame) -> DataFrame:
    """images (image, path) with the guess (path, guess) of their path, else that of the first path with their number; found_by says which."""
    keyed = guesses.select(t.path_key(F.col("path")).alias("_key"), "guess").where("_key != ''")
    by_path = keyed.groupBy("_key").agg(F.max("guess").alias("_exact"))
    by_number = keyed.withColumn("_number", t.number_key(F.col("_key"))).where("_number != ''").groupBy("_number").agg(F.min_by("guess", "_key").alias("_near"))
    rows = images.withColumn("_key", t.path_key(F.col("path"))).withColumn("_number", t.number_key(F.col("_key")))
    rows = rows.join(by_path, "_key", "left").join(by_number, "_number", "left")
    by = F.when(F.col("_exact").isNotNull(), "path").when(F.col("_near").isNotNull(), "number").otherwise("")
    return rows.select("image", "path", F.coalesce("_exact", "_near", F.lit("")).alias("guess"), by.alias("found_by"))


def timing(steps: Column, name: str) -> Column:
    """The first step of that name, in ms; 0 if there is none."""
    return F.coalesce(F.try_element_at(F.filter(steps, lambda s: s["name"] == name), F.lit(1))["ms"], F.lit(0.0))


def notes(lines: Column) -> Column:
    return F.array_join(lines, " | ")


def pending(images: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What isn't computed yet."""
    return images.join(done.select(key).distinct(), key, "left_anti")


def union_datasets(parts: dict[str, DataFrame]) -> DataFrame:
    """All rows with the name of their dataset; columns that a part lacks are null."""
    out = None
    for name, df in parts.items():
        df = df.select(F.lit(name).alias("dataset"), "*")
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out


def latest(rows: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """One row per key, the one with the greatest version."""
    return last_wins(rows, keys, [version])


def chosen(detections: DataFrame, selected: DataFrame, keys: Sequence[str] = ("image",)) -> DataFrame:
    """The detections whose box is that of a selected one of their image."""
    return detections.join(selected.select(*keys, "box").distinct(), [*keys, "box"], "left_semi")


def pending_with(images: DataFrame, done: DataFrame, details: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(what isn't computed yet, the results kept, their detail rows), for a run that goes on where the last one ended."""
    kept = done.join(images.select(key).distinct(), key, "left_semi")
    return pending(images, done, key), kept, details.join(kept.select(key).distinct(), key, "left_semi")


def detection_rows(detections: DataFrame, images: DataFrame, margin: float = 0.04) -> tuple[DataFrame, DataFrame]:
    """(one row per image, one per detection) as the detector's files hold them.

    detections: dataset, image_path, idx, label, conf, x, y, w, h; images: dataset, image_path, image_width, image_height.
    Crops go below crops/<dataset>/<label>; the box and crop of an image's label are those of its most confident detection.
    """
    keys = ["dataset", "image_path"]
    rows = detections.join(images, keys)
    corners = F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    rows = rows.withColumn("_c", expand_corners(corners, F.col("image_width"), F.col("image_height"), margin))
    crop = F.array(F.col("_c.x0"), F.col("_c.y0"), F.col("_c.x1") - F.col("_c.x0"), F.col("_c.y1") - F.col("_c.y0"))
    path = F.concat(F.lit("crops/"), "dataset", F.lit("/"), "label", F.lit("/"), t.safe_stem(t.step_name(F.col("image_path")), "image"), F.lit(".png"))
    every = rows.select(*keys, "idx", "label", F.col("conf").alias("confidence"), F.array("x", "y", "w", "h").alias("box"), crop.alias("crop_box"), path.alias("crop_path"))
    order = F.struct(-F.col("confidence"), "idx")
    best = []
    for label in ("Brand", "Model", "Size", "DOT"):
        mine = F.when(F.col("label") == label, order)
        best += [F.coalesce(F.min_by("crop_path", mine), F.lit("")).alias(f"{label.lower()}_crop_path"), F.coalesce(F.min_by("box", mine), F.array().cast("array<int>")).alias(f"{label.lower()}_box")]
    found = every.groupBy(*keys).agg(*best, F.count("*").cast("int").alias("num_detections"))
    none = [F.coalesce(c, F.array().cast("array<int>") if c.endswith("_box") else F.lit(0) if c == "num_detections" else F.lit("")).alias(c) for c in found.columns[2:]]
    summary = images.join(found, keys, "left").select(*keys, F.lit("ok").alias("status"), "image_width", "image_height", *none)
    return summary, every.drop("idx")


def fill_wheel(current: Column, found: Column, override: Column) -> Column:
    """A wheel's new value: only where it was found and isn't set by hand."""
    return F.when(~override & found.isNotNull(), found).otherwise(current)


def gui_columns(suggestions: DataFrame) -> DataFrame:
    """The batch programs' suggestions under the names that the annotation tool looks up, as text."""
    names = {
        "image": "image_path", "size_base_guess": "size_base", "size_full_guess": "size_full", "size_confidence": "size_confidence", "size_location_hint": "size_box",
        "dot_text_guess": "dot_text", "dot4_guess": "dot4", "dot_confidence": "dot_confidence", "dot_location_hint": "dot_box",
    }
    return suggestions.select(*(F.coalesce(F.col(old).cast("string"), F.lit("")).alias(new) for new, old in names.items()), F.lit("").alias("review_status"), F.lit("").alias("notes"))


def attempts(candidates: DataFrame, variants: Sequence[str], modes: Sequence[str]) -> DataFrame:
    """Each candidate (rank) with every variant and reading mode, numbered in the order in which they are tried."""
    table = F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(m).alias("mode")) for v in variants for m in modes))
    rows = candidates.select("*", F.posexplode(table).alias("_i", "_a"))
    return rows.select(*candidates.columns, F.col("_a.variant").alias("variant"), F.col("_a.mode").alias("mode"), (F.col("rank") * (len(variants) * len(modes)) + F.col("_i")).cast("int").alias("seq"))


def paired_text(pages: Column, first_only: bool) -> Column:
    """struct(text, confidence) of pages (struct texts, scores): all texts in order, squeezed, and the mean score; 0 without scores."""
    used = F.slice(pages, 1, 1) if first_only else pages
    texts, scores = F.flatten(F.transform(used, lambda p: p["texts"])), F.flatten(F.transform(used, lambda p: p["scores"]))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(scores), F.lit(1))
    return F.struct(t.squeeze_unicode(F.array_join(texts, " ")).alias("text"), F.coalesce(mean, F.lit(0.0)).alias("confidence"))


def page_items(pages: Column) -> Column:
    """array of struct(text, score, box): what was read on all pages (struct texts, scores, boxes), in order; lists of a page are as long as its texts."""

    def items(p: Column) -> Column:
        return F.transform(p["texts"], lambda x, i: F.struct(x.alias("text"), F.coalesce(F.try_element_at(p["scores"], i + 1), F.lit(0.0)).alias("score"), F.try_element_at(p["boxes"], i + 1).alias("box")))

    return F.flatten(F.transform(pages, items))


def with_overlay(annotations: DataFrame, answers: DataFrame) -> DataFrame:
    """annotations (image) with the overlay of the answer (path, overlay) for the same path, else the image itself."""
    keyed = answers.select(t.path_key(F.col("path")).alias("_key"), "overlay").groupBy("_key").agg(F.max("overlay").alias("_overlay"))
    rows = annotations.withColumn("_key", t.path_key(F.col("image"))).join(keyed, "_key", "left")
    return rows.withColumn("annotation_image", F.coalesce(F.nullif(t.blank(F.col("_overlay")), F.lit("")), F.col("image"))).drop("_key", "_overlay")
