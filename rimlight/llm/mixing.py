"""Mixing sources to target weights by capped water-filling, in DataFrame operations only.

Targets: a budget is shared by weight; sources whose share exceeds `epochs` times their size are held there and the
excess is shared again among the rest. Its fixed point is found in one pass: in order of cap over weight, the
sources held at their caps are a prefix, and the rest get one common level times their weights.

Repetitions: a source of size s and target t takes each document floor(t / s) times. The fractional repetition takes
documents in the order of a seeded digest until the rest of the target is reached, the last one in part, so that the
words taken are the target, rounded. The place where it ends is found by two rounds of sums over digest prefixes (256
rows a source each); only the documents that share 4 hex digits with it, one in 65,536, are ordered against each other.

Defined cases: null text or no word: size 0, nothing taken; null source: a source of its own, ordered last; a null id
is digested as ''; repeated rows count and are taken once each; a source without words has target 0; an empty table
gives an empty result; docs' own columns are kept aside, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rimlight.llm.common import WORD, stage

WEIGHTS, SHARE, EPOCHS, SEED = (3, 1, 2), 1.5, 2, "7"


def sized(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with _size (words) and _key (seeded digest of the id)."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"_size": size, "_key": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))})


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(_source, _source_size, _target) from rows of (_source, _source_size): one row per source, so windows over all are small."""
    order = Window.orderBy(F.col("_source").asc_nulls_last())
    table = F.array(*(F.lit(w) for w in weights))
    rows = sizes.withColumn("_w", F.element_at(table, ((F.row_number().over(order) - 1) % len(weights) + 1)).cast("long"))
    level = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before, after = level.rowsBetween(Window.unboundedPreceding, -1), level.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_cap", F.lit(epochs).cast("long") * F.col("_source_size"))
    total = F.sum("_source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("double")
    rows = rows.withColumns({"_budget": F.lit(float(share)) * total, "_held": F.coalesce(F.sum("_cap").over(before), F.lit(0)).cast("double"), "_open": F.sum("_w").over(after).cast("double")})
    rows = rows.withColumn("_level", (F.col("_budget") - F.col("_held")) / F.col("_open"))
    fits = F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("_held"), F.col("_level")))
    chosen = F.min(fits).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["_level"]
    cap = F.col("_cap").cast("double")
    return rows.select("_source", "_source_size", F.coalesce(F.least(cap, chosen * F.col("_w")), cap).alias("_target"))


def plan(light: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per source: how often each of its documents is taken, and where the fractional repetition ends.

    light: (_source, _size, _key), read four times; give a written table. Adds _whole, _rest (words of the fractional
    repetition), _end (digest prefix in which it ends) and _done (words before that prefix).
    """
    sums = light.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    goals = targets(sums, weights, share, epochs)
    whole = F.coalesce(F.floor(F.try_divide("_target", "_source_size")), F.lit(0)).cast("long")
    goals = goals.withColumn("_whole", whole)
    goals = goals.withColumn("_rest", F.floor(F.col("_target") - F.col("_whole") * F.col("_source_size") + 0.5).cast("long"))
    goals = goals.withColumns({"_end": F.lit(""), "_done": F.lit(0).cast("long")})
    columns = goals.columns
    for digits in (2, 4):
        # sums come first, and the second level joins on the first one's digits, too: no task gets a whole source
        part = F.substring("_key", 1, digits).alias("_part")
        if digits == 2:
            sums = light.groupBy(F.col("_source").alias("_s"), part).agg(F.sum("_size").alias("_n"))
        else:
            g = goals.where("_rest > 0").select(F.col("_source").alias("_s"), F.col("_end").alias("_e"))
            inside = light.join(g, F.col("_source").eqNullSafe(F.col("_s")) & (F.substring("_key", 1, 2) == F.col("_e")))
            sums = inside.groupBy("_s", part).agg(F.sum("_size").alias("_n"))
        g = goals.where("_rest > 0").select("_source", "_rest", "_done")
        sums = sums.join(g, F.col("_source").eqNullSafe(F.col("_s")))
        upto = F.sum("_n").over(Window.partitionBy("_s").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("_upto", upto + F.col("_done"))
        ends = sums.where("_upto >= _rest and _upto - _n < _rest").select("_s", F.col("_part").alias("_e"), (F.col("_upto") - F.col("_n")).alias("_d"))
        goals = goals.join(ends, F.col("_source").eqNullSafe(F.col("_s")), "left")
        goals = goals.withColumns({"_end": F.coalesce("_e", "_end"), "_done": F.coalesce("_d", "_done")}).select(columns)
        goals = stage(goals, "goals")  # a row per source
    return goals


def take(docs: DataFrame, goals: DataFrame) -> DataFrame:
    """docs (with _source, _size, _key) with their source's row of `plan` and _taken, the words that the mix takes."""
    part = F.substring("_key", 1, 4)
    named = goals.withColumnRenamed("_source", "_s")
    same = F.col("_source").eqNullSafe(F.col("_s"))
    base = F.col("_whole") * F.col("_size")
    clear = docs.join(named, same).where((F.col("_rest") <= 0) | (part != F.col("_end")))
    clear = clear.withColumn("_taken", base + F.when((F.col("_rest") > 0) & (part < F.col("_end")), F.col("_size")).otherwise(0))
    near = docs.join(named.where("_rest > 0"), same & (part == F.col("_end")))
    order = Window.partitionBy("_source").orderBy("_key", F.col("doc_id").asc_nulls_first(), "_size")
    before = F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = near.withColumn("_taken", base + F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_done") - before)))
    return clear.unionByName(near).drop("_s")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken for each row of docs (doc_id, text, source)."""
    light = sized(docs.select("doc_id", "text", F.col("source").alias("_source")), seed).select("doc_id", "_source", "_size", "_key")
    light = stage(light, "mixing")
    out = take(light, plan(light, weights, share, epochs))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").cast("long").alias("taken"))


def repeat(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """The mixed corpus itself: docs' rows as often as they are taken, in docs' columns; a part is a text's first words."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    all_sized = sized(docs.withColumn("_source", F.col("source")), seed)
    light = stage(all_sized.select("doc_id", "_source", "_size", "_key"), "mixing")
    rows = take(all_sized, plan(light, weights, share, epochs)).where("_taken > 0")
    full, part = (F.col("_taken") / F.col("_size")).cast("int"), (F.col("_taken") % F.col("_size")).cast("int")
    rows = rows.withColumn("_n", F.explode(F.concat(F.array_repeat(F.col("_size").cast("int"), full), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<int>")))))
    first = F.call_function("regexp_extract", F.col("text"), F.concat(F.lit(r"(?s)^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("_n").cast("string"), F.lit("}+")), F.lit(0))
    rows = rows.withColumn("text", F.when(F.col("_n") < F.col("_size"), first).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_n") < F.col("_size"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(columns)


ORACLE = """
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
         md5('7:' || coalesce(doc_id::varchar, '')) as k
  from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as i from d group by source),
w as (select source, source_size, case (i - 1) % 3 when 0 then 3 when 1 then 1 else 2 end::bigint as w, 2 * source_size as cap from s),
v as (select *, cap / w::double as r, cast(1.5 as double) * (sum(source_size) over ())::double as budget,
             coalesce(sum(cap) over (order by cap / w::double, source nulls last rows between unbounded preceding and 1 preceding), 0)::double as held,
             (sum(w) over (order by cap / w::double, source nulls last rows between current row and unbounded following))::double as still from w),
l as (select arg_min((budget - held) / still, r) as level from v where (budget - held) / still <= r),
t as (select source, source_size, least(cap::double, coalesce(level * w, cap::double)) as target from v cross join l),
p as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from t),
q as (select *, floor(target - whole * source_size + cast(0.5 as double))::bigint as rest from p),
c as (select d.doc_id, d.size, q.source_size, q.target, q.whole, q.rest,
             coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id nulls first, d.size rows between unbounded preceding and 1 preceding), 0) as before
      from d join q on d.source is not distinct from q.source)
select doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::bigint as taken from c
"""
