"""Stand-ins for recognition output, derived from the driver's tables by arithmetic that both engines share.

Each entry is one SELECT in the common part of both SQL dialects; {table} names are filled in by either engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ORDER = "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"
_SEQ = f"row_number() over (partition by l_orderkey order by {_ORDER})"
_W, _A, _R = "concat('', 125 + 10 * (l_partkey % 28))", "concat('', 20 + 5 * (l_suppkey % 16))", "concat('', 10 + (l_orderkey + l_linenumber) % 15)"
_WEEK, _YEAR = "lpad(concat('', 1 + l_suppkey % 53), 2, '0')", "lpad(concat('', l_partkey % 30), 2, '0')"

SQL = {
    # candidates of recognition: image, field, seq (order of evaluation), text, conf, quality
    "ocr": f"""
        select l_orderkey as image, case when l_partkey % 3 = 0 then 'dot' else 'size' end as field, cast({_SEQ} as int) as seq,
          cast(l_partkey * 37 % 101 as double) / 100 as conf, cast(l_suppkey * 53 % 101 as double) / 100 as quality,
          case (l_orderkey + l_linenumber) % 8
            when 0 then concat({_W}, '/', {_A}, ' R', {_R})
            when 1 then concat({_W}, {_A}, {_R})
            when 2 then concat('  ', {_W}, chr(92), {_A}, ' r', {_R}, '  v ')
            when 3 then concat(replace({_W}, '0', 'O'), '/', {_A}, ' R1S')
            when 4 then concat('DOT 1AB', {_W}, ' ', {_WEEK}, {_YEAR})
            when 5 then concat({_WEEK}, {_YEAR})
            when 6 then concat('399/40 R18 ', {_W}, '/', {_A}, ' R', {_R})
            else concat('dot ', {_W}, ' tyre ') end as text
        from {{lineitem}}""",
    # ground truth; every fifth order has an earlier row, which the later one replaces
    "expected": """
        select o_orderkey as image, rank, case when o_orderkey % 7 = 0 then '' else concat('', 125 + 10 * (o_custkey % 28), '/', 20 + 5 * (o_custkey % 16), ' R', 10 + o_orderkey % 15) end as expected_size,
          case when o_orderkey % 5 = 0 then '' else concat(lpad(concat('', 1 + o_custkey % 53), 2, '0'), lpad(concat('', o_custkey % 30), 2, '0')) end as expected_dot4,
          case when o_orderkey % 3 = 0 then '' else concat('DOT1AB', 125 + 10 * (o_custkey % 28), lpad(concat('', 1 + o_custkey % 53), 2, '0')) end as expected_full,
          o_orderstatus as brand, concat('M', o_custkey % 9) as model, o_orderpriority as difficulty, case when o_orderkey % 4 = 0 then 'a, "b"' else '' end as notes
        from (select *, 2 as rank from {orders} union all select o_orderkey, o_custkey + 1 as o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, 1 as rank from {orders} where o_orderkey % 5 = 1) o""",
    # detections: image, idx, label, conf, box in a 640 x 480 image
    "detections": f"""
        select l_orderkey as image, cast({_SEQ} as int) as idx, case l_linenumber % 4 when 0 then 'Size' when 1 then 'DOT' when 2 then 'Model' else 'Brand' end as label,
          cast(l_partkey * 37 % 101 as double) / 100 as conf, cast(l_partkey * 7 % 560 - 10 as int) as x, cast(l_suppkey * 11 % 420 - 10 as int) as y,
          cast(20 + l_partkey % 150 as int) as w, cast(10 + l_suppkey % 90 as int) as h
        from {{lineitem}}""",
    # a signal per user: x = 0, 1, ... and a value from 0 to 255
    "signal": """
        select user_id as image, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as x, cast(event_id * 37 % 256 as double) as value from {events}""",
    # text components per user, in order of x
    "components": """
        select user_id as image, cast(event_id as int) as idx, cast(30 * (row_number() over (partition by user_id order by ts, event_id)) + event_id * 13 % 40 as int) as x,
          cast(event_id * 7 % 25 as int) as y, cast(5 + event_id * 11 % 20 as int) as w, cast(12 + event_id * 5 % 20 as int) as h,
          cast(event_id * 7 % 25 as double) + cast(12 + event_id * 5 % 20 as double) / 2 as cy
        from {events}""",
    # timings per image, several of one name
    "timings": """
        select user_id as image, cast(row_number() over (partition by user_id order by ts, event_id) as int) as idx, event_type as name, cast(event_id * 31 % 997 as double) / 10 as ms from {events}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver's table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in as a DataFrame. Left to themselves, Spark sorts nulls first and DuckDB last: here, they are last, too."""
    sql = SQL[name].replace(f"order by {_ORDER})", f"order by {_ORDER.replace(',', ' nulls last,')} nulls last)")
    used = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders", "events") if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def duck(name: str) -> str:
    """A stand-in as a parenthesized subquery for DuckDB."""
    sql = SQL[name]
    for t in ("lineitem", "orders", "events"):
        sql = sql.replace(f"{{{t}}}", t)
    return f"({sql})"
