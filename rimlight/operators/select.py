"""Winners among ordered readings, where the order of evaluation and early stops decide."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE_STOP, DOT_STOP, ROI_STOP = 0.84, 0.76, 0.65


def size_order(conf: Column, seq: Column, stop: float = SIZE_STOP) -> Column:
    """What the winner has least of: rows at `stop` come first, in order, then the most confident."""
    sure = conf >= stop
    return F.struct(F.when(sure, 0).otherwise(1).alias("late"), F.when(sure, 0.0).otherwise(-conf).alias("doubt"), seq.alias("seq"))


def size_winner(rows: DataFrame, keys: Sequence[str], conf: str = "conf", seq: str = "seq", found: str = "found", stop: float = SIZE_STOP) -> DataFrame:
    """Per key the first row that reaches `stop`, else the first of the most confident; rows not found or without confidence never win."""
    c = F.col(conf)
    live = rows.where(F.col(found) & (c > 0))
    return live.groupBy(*keys).agg(F.min_by(F.struct(*live.columns), size_order(c, F.col(seq), stop)).alias("_w")).select("_w.*")


def dot_winner(rows: DataFrame, keys: Sequence[str], conf: str = "conf", seq: str = "seq", found: str = "found", dated: str = "week_year_found", stop: float = DOT_STOP) -> DataFrame:
    """Reading ends with the first dated row at `stop`, yet the best row so far wins, which need not be that one."""
    c, s = F.col(conf), F.col(seq)
    live = rows.where(F.col(found) & (c > 0))
    cut = F.min(F.when(F.col(dated) & (c >= stop), s)).over(Window.partitionBy(*keys))
    live = live.withColumn("_cut", cut).where(F.col("_cut").isNull() | (s <= F.col("_cut"))).drop("_cut")
    return live.groupBy(*keys).agg(F.min_by(F.struct(*live.columns), F.struct(-c, s)).alias("_w")).select("_w.*")


def roi_winner(rows: DataFrame, keys: Sequence[str], score: str = "score", seq: str = "seq", ok: str = "ok", stop: float = ROI_STOP) -> DataFrame:
    """Every row competes, parsed or not; only a new best that is ok and reaches `stop` ends the reading."""
    sc, s = F.col(score), F.col(seq)
    before = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.max(sc).over(before), F.lit(-1.0))
    live = rows.withColumn("_best", best)
    cut = F.min(F.when((sc > F.col("_best")) & F.col(ok) & (sc >= stop), s)).over(Window.partitionBy(*keys))
    live = live.withColumn("_cut", cut).where(F.col("_cut").isNull() | (s <= F.col("_cut"))).drop("_cut", "_best")
    return live.groupBy(*keys).agg(F.min_by(F.struct(*live.columns), F.struct(-sc, s)).alias("_w")).select("_w.*")


def first_found(rows: DataFrame, keys: Sequence[str], rank: str, found: str = "found") -> DataFrame:
    """Per key the found row of the lowest rank."""
    live = rows.where(F.col(found))
    return live.groupBy(*keys).agg(F.min_by(F.struct(*live.columns), F.col(rank)).alias("_w")).select("_w.*")


def status(keys: Sequence[str], conf: Column, found: Column, seq: str = "seq") -> Column:
    """parse_miss, candidate_best (better than all before) or candidate_weaker."""
    before = Window.partitionBy(*keys).orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.max(F.when(found, conf)).over(before), F.lit(0.0))
    return F.when(~found, "parse_miss").when(conf > best, "candidate_best").otherwise("candidate_weaker")


def top(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def capped(rows: DataFrame, keys: Sequence[str], field: str, seq: str = "seq", probes: tuple[int, int] = (5, 6)) -> DataFrame:
    """The first probes of each key: 5 for a size, 6 for a DOT."""
    limit = F.when(F.col(field) == "size", probes[0]).otherwise(probes[1])
    order = Window.partitionBy(*keys, field).orderBy(seq)
    return rows.withColumn("_n", F.row_number().over(order)).where((F.col("_n") <= max(probes)) & (F.col("_n") <= limit)).drop("_n")


def ranked_report(rows: DataFrame, keys: Sequence[str], score: str, quality: str, k: int = 10) -> DataFrame:
    """The candidates' report: the k best by score with their place from 0, box, scores and why they are there."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc(), "name")
    best = rows.withColumn("index", (F.row_number().over(order) - 1).cast("int")).where(F.col("index") < k)
    box = [F.col("x"), F.col("y"), F.col("w").alias("width"), F.col("h").alias("height")]
    return best.select(*keys, "index", "name", *box, F.col(score).alias("structure_score"), F.col(quality).alias("roi_quality"), F.lit("top_size_candidate").alias("selection_reason"))


def report(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The recognition report's 14 columns (after keys): what was read where, how it was scored and whether it was the best so far."""
    best = status([*keys, "field"], F.col("conf"), F.col("found"))
    columns = {
        "branch": F.col("field"), "roi_id": F.col("roi_id"), "variant": F.col("variant"), "psm": F.col("psm"), "width": F.col("width"), "height": F.col("height"), "elapsed_ms": F.col("elapsed_ms"),
        "ocr_conf": F.col("ocr"), "regex_valid": F.col("found"), "domain_score": F.col("score"), "final_score": F.col("conf"), "status": best, "text": F.col("text"), "normalized": F.col("normalized"),
    }
    return rows.select(*keys, "seq", *(v.alias(k) for k, v in columns.items()))


def last_wins(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in the given order, as a keyed table built row by row would hold."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("_w")).select("_w.*")


def wheel_choice(isolated: Column, combo: Column, dark: Column, hole: Column) -> Column:
    """The wheel hypothesis that counts: isolated, then combined, then the dark contour only where it scores above the hole."""
    return F.coalesce(isolated, combo, F.when(dark["score"] > hole["score"], dark).otherwise(hole))
