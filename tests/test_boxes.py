"""Boxes whose results hang on last bits or on their order."""

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from rimlight.operators import boxes
from rimlight.plans import registry
from tests import duck

#: Parts and suppliers whose boxes are in line with the center, so that two gaps between angles are equal but for rounding.
IN_LINE = [(4524, 174), (924, 1163), (5724, 1128), (8124, 438), (924, 514), (1402, 896), (1795, 860), (4195, 860), (5395, 860), (2359, 860), (2205, 670), (6596, 860)]


@pytest.mark.parametrize("name", ["angle_range", "local_ring"])
def test_equal_gaps_same_as_sql(spark, tmp_path, name):
    part, supplier = (pa.array(x, pa.int64()) for x in zip(*IN_LINE, strict=True))
    rest = pq.read_schema(f"{duck.DATA}/lineitem.parquet")
    columns = {"l_orderkey": pa.array(range(len(IN_LINE)), pa.int64()), "l_partkey": part, "l_suppkey": supplier, "l_linenumber": pa.array([1] * len(IN_LINE), rest.field("l_linenumber").type)}
    pq.write_table(pa.table([columns.get(f.name, pa.nulls(len(IN_LINE), f.type)) for f in rest], schema=rest), tmp_path / "lineitem.parquet")
    duck.same(registry.QUERIES[name](spark, str(tmp_path)), registry.ORACLES[name], duck.connection(str(tmp_path)))


#: Order, part, supplier and line number: each null in turn, beside rows that tie but for it, and all of them.
NULL_KEYS = [(1, 5, 7, 1), (1, None, 9, 1), (1, 3, None, 1), (1, 8, 2, None), (2, None, None, 1), (2, 924, None, 2), (3, None, 514, 1), (None, 11, 13, 1), (None, None, None, None)]


@pytest.mark.parametrize("missing", ["order", "part", "supplier", "line", "all"])
def test_null_keys_same_as_sql(spark, tmp_path, missing):
    at = ["order", "part", "supplier", "line", "all"].index(missing)
    rows = [r for r in NULL_KEYS if all(x is not None or at in (i, 4) for i, x in enumerate(r))]
    rest = pq.read_schema(f"{duck.DATA}/lineitem.parquet")
    names = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    columns = {n: pa.array(x, rest.field(n).type) for n, x in zip(names, zip(*rows, strict=True), strict=True)}
    pq.write_table(pa.table([columns[f.name] if f.name in columns else pa.nulls(len(rows), f.type) for f in rest], schema=rest), tmp_path / "lineitem.parquet")
    duck.same(registry.QUERIES["local_ring"](spark, str(tmp_path)), registry.ORACLES["local_ring"], duck.connection(str(tmp_path)))


def plainly_merged(now, width, height):
    grown = True
    while grown:
        grown, rest, out = False, list(now), []
        while rest:
            (x, y, w, h), others, rest = rest[0], rest[1:], []
            for o in others:
                gap_x = max(0, max(x, o[0]) - min(x + w, o[0] + o[2]))
                gap_y = max(0, max(y, o[1]) - min(y + h, o[1] + o[3]))
                level = abs((y + h // 2) - (o[1] + o[3] // 2)) < max(h, o[3])
                if (gap_x < width // 40 and level) or (gap_y < height // 60 and gap_x < width // 12):
                    right, low = max(x + w, o[0] + o[2]), max(y + h, o[1] + o[3])
                    x, y = min(x, o[0]), min(y, o[1])
                    w, h, grown = right - x, low - y, True
                else:
                    rest.append(o)
            out.append((x, y, w, h))
        now = out
    return now


def test_merging_as_plain_loops(spark):
    r = random.Random(11)
    sizes = [r.randint(1, 9) for _ in range(300)] + [32, 33, 40, 700]
    data = {f"i{k}": [(r.randint(-50, 640 * (1 + n // 20)), r.randint(-50, 480 * (1 + n // 20)), r.randint(0, 60), r.randint(0, 40)) for _ in range(n)] for k, n in enumerate(sizes)}
    rows = [(k, i, *b) for k, v in data.items() for i, b in enumerate(v)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "image string, idx int, x int, y int, w int, h int")
    for width, height in ((640, 480), (30, 50)):
        got = {}
        for x in boxes.merge_nearby(df, "image", width, height).orderBy("image", "idx").collect():
            assert x.idx == len(got.setdefault(x.image, []))
            got[x.image].append(tuple(x)[2:])
        assert got == {k: plainly_merged(v, width, height) for k, v in data.items()}


def test_merging_with_nulls(spark):
    rows = [(1, 2, 12, 0, 10, 10), (1, 0, 0, 0, 10, 10), (1, 1, None, 0, 10, 10), (None, 0, 5, 5, 5, 5), (2, None, 3, 0, 9, 9), (2, 7, 1, 0, 1, 1)]
    got = boxes.merge_nearby(spark.createDataFrame(rows, "image int, idx int, x int, y int, w int, h int"), "image", 640, 480).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted([(1, 0, 0, 0, 22, 10), (1, 1, None, 0, 10, 10), (None, 0, 5, 5, 5, 5), (2, 0, 1, 0, 11, 9)], key=repr)
    assert boxes.merge_nearby(spark.createDataFrame([], "image int, idx int, x int, y int, w int, h int"), "image", 640, 480).collect() == []


def test_merging_calls_python_by_batches(spark):
    plan = registry.QUERIES["merge_nearby"](spark, duck.DATA)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
