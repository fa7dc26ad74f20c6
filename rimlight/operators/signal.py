"""Ordered computations over one-dimensional signals and runs of components: windows, folds and sums, no UDFs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_average(value: Column, keys: Sequence[str], order: str, radius: int) -> Column:
    """Centered mean, over fewer values at the ends."""
    return F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius))


def moving_sum_mean(value: Column, keys: Sequence[str], order: str, radius: int) -> Column:
    """Centered mean with zeros beyond the ends."""
    return F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius)) / (2 * radius + 1)


def zero_padded_step(value: Column, keys: Sequence[str], order: str, radius: int = 3) -> Column:
    """What the zero-padded mean gains at the next place: both are sums, so one window has the difference."""
    w = Window.partitionBy(*keys).orderBy(order)
    return (F.lead(value, radius + 1, 0.0).over(w) - F.lag(value, radius, 0.0).over(w)) / (2 * radius + 1)


def border(rows: DataFrame, keys: Sequence[str], x: str, value: str, bright: float = 80.0, dark: float = 50.0) -> DataFrame:
    """Per key the first place that is dark at or after a bright one (border)."""
    upto = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    seen = F.max(F.when(F.col(value) > bright, 1).otherwise(0)).over(upto)
    return rows.withColumn("_seen", seen).groupBy(*keys).agg(F.min(F.when((F.col("_seen") == 1) & (F.col(value) < dark), F.col(x))).alias("border"))


def last_drop(rows: DataFrame, keys: Sequence[str], x: str, value: str, drop: float = -10.0, beyond: float = 100.0, place: str | None = None) -> DataFrame:
    """Per key the last place (not the first) whose next value is lower by more than -drop and whose radius is beyond (radius)."""
    w = Window.partitionBy(*keys).orderBy(x)
    r = F.col(place or x)
    step = rows.withColumns({"_g": F.lead(value).over(w) - F.col(value), "_i": F.row_number().over(w)})
    hit = (F.col("_g") < drop) & (r > beyond) & (F.col("_i") > 1)
    return step.groupBy(*keys).agg(F.max_by(F.when(hit, r), F.when(hit, F.col(x))).alias("radius"))


def runs(rows: DataFrame, keys: Sequence[str], size: bool = True) -> DataFrame:
    """Components (x, y, w, h, cy) in order of x with run: a new one where the gap or the step between middles is large."""
    w = Window.partitionBy(*keys).orderBy("x", "idx")
    gap = F.col("x") - (F.lag("x").over(w) + F.lag("w").over(w))
    tall = (F.col("h") + F.lag("h").over(w)) * 0.5
    step = F.abs(F.col("cy") - F.lag("cy").over(w))
    split = (gap > F.greatest(F.lit(18.0), tall * (1.1 if size else 1.4))) | (step > F.greatest(F.lit(18.0), tall * 0.65))
    rows = rows.withColumns({"gap": gap, "_split": F.coalesce(split, F.lit(False)).cast("int")})
    return rows.withColumn("run", F.sum("_split").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_split")


def run_stats(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per run its box, size, mean height, mean distance of middles from the box's, gaps and counts of slender and wide ones.

    rows: of `runs`. The first gap of a run belongs to the split before it and doesn't count.
    """
    own = [*keys, "run"]
    w = Window.partitionBy(*own)
    first = F.row_number().over(w.orderBy("x", "idx")) == 1
    rows = rows.withColumns({"_gap": F.when(~first, F.col("gap")), "_top": F.min("y").over(w), "_bottom": F.max(F.col("y") + F.col("h")).over(w), "_tall": F.avg("h").over(w)})
    off = F.abs(F.col("cy") - (F.col("_top") + (F.col("_bottom") - F.col("_top")) * 0.5))
    ratio = F.col("w") / F.greatest(F.lit(1.0), F.col("_tall"))
    return rows.groupBy(*own).agg(
        F.min("x").cast("long").alias("x"), F.min("y").cast("long").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).cast("long").alias("w"),
        (F.max(F.col("y") + F.col("h")) - F.min("y")).cast("long").alias("h"), F.count("*").alias("n"), F.avg("h").alias("avg_height"), F.avg(off).alias("jitter"),
        F.avg("_gap").alias("gap_mean"), F.coalesce(F.stddev_pop("_gap"), F.lit(0.0)).alias("gap_std"),
        F.count_if(ratio < 0.38).alias("slender"), F.count_if(ratio > 0.55).alias("wide"),
    )


def best_range(rows: DataFrame, keys: Sequence[str], i: str, value: str, least: Column | int, most: Column | int) -> DataFrame:
    """Per key the span [start, end) of least to most values with the largest sum, the first of equals; the whole if none fits.

    rows: places 0, 1, ... per key; least and most: numbers, or columns over n, the values of the key. The best start of
    an end is the least running sum in a window that ends `least` before it: with places cut in blocks of a window's
    length, that is the least of a block's end and the next one's beginning, so all is linear in the values.
    """
    n = F.count("*").over(Window.partitionBy(*keys))
    upto = F.sum(value).over(Window.partitionBy(*keys).orderBy(i).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.select(*keys, (F.col(i) + 1).cast("int").alias("at"), upto.alias("upto"), n.cast("int").alias("n"))
    rows = rows.unionByName(rows.groupBy(*keys).agg(F.lit(0).alias("at"), F.lit(0.0).alias("upto"), F.max("n").alias("n")))
    low = F.greatest(F.lit(1), least if isinstance(least, Column) else F.lit(least)).cast("int")
    rows = rows.withColumn("_low", low)
    rows = rows.withColumn("_len", (F.greatest(F.col("_low"), (most if isinstance(most, Column) else F.lit(most)).cast("int")) - F.col("_low") + 1).cast("int"))
    rows = rows.withColumns({"_b": F.floor(F.col("at") / F.col("_len")).cast("int"), "_s": F.struct(F.col("upto").alias("upto"), F.col("at").alias("start"))})
    own = Window.partitionBy(*keys, "_b").orderBy("at")
    rows = rows.withColumns({"_head": F.min("_s").over(own.rowsBetween(Window.unboundedPreceding, 0)), "_tail": F.min("_s").over(own.rowsBetween(0, Window.unboundedFollowing))})
    heads = rows.select(*keys, (F.col("at") + F.col("_low")).alias("at"), F.col("_head").alias("_h"))
    tails = rows.select(*keys, (F.col("at") + F.col("_low") + F.col("_len") - 1).alias("at"), F.col("_tail").alias("_t"))
    ends = rows.select(*keys, "at", "upto", "n").join(heads, [*keys, "at"], "left").join(tails, [*keys, "at"], "left")
    first = F.when(F.col("_t").isNotNull(), F.least("_h", "_t")).otherwise(F.col("_h"))
    ends = ends.withColumn("_f", first)
    order = F.when(F.col("_f").isNotNull(), F.struct(F.col("_f.upto") - F.col("upto"), F.col("_f.start"), F.col("at")))
    best = ends.groupBy(*keys).agg(F.max("n").alias("n"), F.min_by(F.struct(F.col("_f.start").alias("start"), F.col("at").alias("end")), order).alias("_b"))
    return best.select(*keys, F.coalesce("_b.start", F.lit(0)).alias("start"), F.coalesce("_b.end", "n").alias("end"))


def circle_fit(rows: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", flat: float = 1e-12) -> DataFrame:
    """Least-squares circle (cx, cy, radius) per key, from sums around the mean; null for fewer than 3 points or (nearly, by flat) on a line."""
    mid = rows.groupBy(*keys).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.count("*").alias("_n"))
    near = rows.join(mid, list(keys)).withColumns({"_u": F.col(x) - F.col("_mx"), "_v": F.col(y) - F.col("_my")})
    u, v = F.col("_u"), F.col("_v")
    z = u * u + v * v
    s = near.groupBy(*keys, "_mx", "_my", "_n").agg(F.sum(u * u).alias("uu"), F.sum(u * v).alias("uv"), F.sum(v * v).alias("vv"), F.sum(u * z).alias("uz"), F.sum(v * z).alias("vz"))
    det = F.col("uu") * F.col("vv") - F.col("uv") * F.col("uv")
    fine = (F.col("_n") >= 3) & (F.abs(det) > flat * F.col("uu") * F.col("vv"))
    a = (F.col("uz") * F.col("vv") - F.col("vz") * F.col("uv")) / (2 * F.when(fine, det))
    b = (F.col("vz") * F.col("uu") - F.col("uz") * F.col("uv")) / (2 * F.when(fine, det))
    radius = F.sqrt(a * a + b * b + (F.col("uu") + F.col("vv")) / F.col("_n"))
    return s.select(*keys, (F.col("_mx") + a).alias("cx"), (F.col("_my") + b).alias("cy"), radius.alias("radius"))


def whole_circle(rows: DataFrame) -> DataFrame:
    """A fitted circle in whole numbers, cut off as the batch tool does."""
    return rows.withColumns({c: F.col(c).cast("int") for c in ("cx", "cy", "radius")})


def order_stats(values: Column) -> Column:
    """struct(q25, median, q75, upper): sorted values at n/4, n/2 and 3n/4 without interpolation."""
    s, n = F.sort_array(values), F.size(values)

    def at(k: int) -> Column:
        return F.element_at(s, (F.floor(n * k / 4) + 1).cast("int"))

    return F.struct(at(1).alias("q25"), at(2).alias("median"), at(3).alias("q75"))


def probes(image_w: Column, image_h: Column, field: str) -> Column:
    """array of struct(name, x, y, w, h): the bands and sliding windows of a strip, clamped, those of at least 80 x 20."""

    def part(n: Column, k: int) -> Column:
        return F.floor(n / k).cast("int")

    zero = F.lit(0)
    bands = [
        ("full", zero, zero, image_w, image_h), ("mid", zero, part(image_h, 4), image_w, part(image_h, 2)), ("top", zero, zero, image_w, part(image_h, 2)),
        ("bottom", zero, part(image_h, 2), image_w, part(image_h, 2)), ("center_band", zero, part(image_h, 3), image_w, F.greatest(F.lit(24), part(image_h, 3))),
    ]
    if field == "size":
        width, stride, y, h = F.greatest(F.lit(260), part(image_w, 3)), F.greatest(F.lit(180), part(image_w, 6)), part(image_h, 5), F.greatest(F.lit(28), part(image_h * 3, 5))
    else:
        width, stride, y, h = F.greatest(F.lit(180), part(image_w, 3)), F.greatest(F.lit(120), part(image_w, 5)), part(image_h, 4), F.greatest(F.lit(28), part(image_h, 2))

    def cell(name: Column, x: Column, top: Column, w: Column, tall: Column) -> Column:
        return F.struct(name.alias("name"), x.cast("int").alias("x"), top.cast("int").alias("y"), F.least(w, image_w - x).cast("int").alias("w"), F.least(tall, image_h - top).cast("int").alias("h"))

    fixed = F.array(*(cell(F.lit(f"{field}_{n}"), *b) for n, *b in bands))
    slid = F.transform(F.sequence(F.lit(0), F.greatest(image_w - 1, F.lit(0)), stride), lambda x, i: cell(F.concat(F.lit(f"{field}_win_"), i), x, y, width, h))
    return F.filter(F.concat(fixed, F.when(image_w > 0, slid).otherwise(F.slice(slid, 1, 0))), lambda p: (p["w"] >= 80) & (p["h"] >= 20))
