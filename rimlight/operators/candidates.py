"""Lines of text on an unwrapped strip: runs of components, windows at its seam, and windows of high energy if there are none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimlight.functions import geometry as g
from rimlight.functions.text import clamp01
from rimlight.operators import filters, signal

EDGE_SCORE, ENERGY_SCORE = 0.62, 0.30
LIMITS = {"size": 6, "dot": 8}
COLUMNS = ("image", "kind", "idx", "x", "y", "w", "h", "score", "quality")


def _between(x: Column, low: int, high: Column | int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def _part(x: Column, share: float) -> Column:
    return F.floor(x * share).cast("int")


def seamed(strips: DataFrame) -> DataFrame:
    """strips (image, cols, rows, quality) with over, the columns that a long one repeats at each end, and wide, its columns then."""
    over = F.when(F.col("cols") > F.col("rows") * 4, _between(_part(F.col("cols"), 1 / 6), 120, 640)).otherwise(0)
    return strips.withColumn("over", over.cast("int")).withColumn("wide", F.col("cols") + 2 * F.col("over"))


def _mapped(rows: DataFrame, kind: str, idx: Column, score: Column) -> DataFrame:
    """rows with a box on the repeated strip as candidates on the strip itself."""
    at = filters.unseamed(F.col("box.x"), F.col("box.w"), F.col("cols"), F.col("over"))
    at = F.when(F.col("over") > 0, at).otherwise(F.struct(F.col("box.x").alias("x"), F.col("box.w").alias("w")))
    return rows.withColumn("_at", at).select("image", F.lit(kind).alias("kind"), idx.cast("int").alias("idx"), F.col("_at.x").alias("x"), F.col("box.y").alias("y"), F.col("_at.w").alias("w"), F.col("box.h").alias("h"), score.alias("score"), "quality")


def of_runs(components: DataFrame, strips: DataFrame, field: str) -> DataFrame:
    """Candidates from components (image, idx, x, y, w, h, cy, area) of the repeated strips."""
    c = F.col
    kept = components.join(strips.select("image", "wide", "rows"), "image").where(filters.component(field, c("w"), c("h"), c("area"), c("wide"), c("rows")))
    stats = signal.run_stats(signal.runs(kept.drop("wide", "rows"), ["image"], size=field == "size"), ["image"]).withColumnRenamed("wide", "broad").join(strips, "image")
    raw = filters.run_box(F.struct(*(c(x).cast("int").alias(x) for x in "xywh")), c("avg_height"))
    rows = stats.withColumn("box", g.clamp_rect(raw, c("wide"), c("rows")))
    aspect = c("box.w").cast("double") / F.greatest(F.lit(1), c("box.h"))
    parts = [c(x) for x in ("avg_height", "jitter", "gap_mean", "gap_std", "slender", "broad")]
    rows = rows.withColumn("_structure", g.structure_score(field, c("n"), aspect, *parts, c("rows"), c("quality")))
    rows = rows.where(filters.candidate(field, c("box.w"), c("box.h"), c("n"), c("wide"), c("_structure")))
    place = F.row_number().over(Window.partitionBy("image").orderBy("run")) - 1
    return _mapped(rows, "run", place, clamp01(0.78 * c("_structure") + 0.22 * c("quality")))


def of_edges(strips: DataFrame) -> DataFrame:
    """The windows near the seam of long strips."""
    rows = strips.where("over > 0").select("*", F.posexplode(filters.edge_windows(F.col("cols"), F.col("rows"), F.col("over"))).alias("_i", "_box"))
    rows = rows.withColumn("box", g.clamp_rect(F.col("_box"), F.col("wide"), F.col("rows"))).where("box.w >= 120 and box.h >= 40")
    return _mapped(rows, "edge", F.col("_i"), F.lit(EDGE_SCORE))


def of_energy(strips: DataFrame, field: str) -> DataFrame:
    """Windows around the peaks of energy (centers, an array of columns, of `boxes.peaks`), or at fixed places where there are none."""
    wide, rows = F.col("wide"), F.col("rows")
    fixed = F.array(*(F.floor(wide * a / b).cast("int") for a, b in ((1, 8), (1, 3), (1, 2), (2, 3), (7, 8))))
    width = _between(_part(wide, 1 / 32), 160, 540) if field == "size" else _between(_part(wide, 1 / 48), 100, 280)
    out = strips.withColumn("_w", width).select("*", F.posexplode(F.when(F.size("centers") > 0, F.col("centers")).otherwise(fixed)).alias("_i", "_center"))
    box = g.box(F.col("_center") - F.floor(F.col("_w") / 2).cast("int"), F.floor(rows / 8).cast("int"), F.col("_w"), F.greatest(F.lit(32), F.floor(rows * 6 / 8).cast("int")))
    out = out.withColumn("box", g.clamp_rect(box, wide, rows)).where("box.w >= 60 and box.h >= 24")
    return _mapped(out, "energy", F.col("_i"), F.lit(ENERGY_SCORE))


def sidewall(components: DataFrame, strips: DataFrame, field: str) -> DataFrame:
    """The candidates of each strip (image, cols, rows, quality, centers) that are worth reading, best first (rank from 0)."""
    strips = seamed(strips)
    found = of_runs(components, strips, field)
    if field == "size":
        found = of_edges(strips).unionByName(found)
    rest = of_energy(strips.join(found.select("image").distinct(), "image", "left_anti"), field)
    rows = found.unionByName(rest).select(*COLUMNS)
    order = Window.partitionBy("image").orderBy((F.col("score") + F.col("quality")).desc(), "kind", "idx")
    return rows.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < LIMITS[field])
