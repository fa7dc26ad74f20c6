"""Winners, greedy choices and signals against plain loops."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rimlight.functions import geometry as g
from rimlight.operators import boxes, etl, providers, select, signal


def groups(seed, n=150):
    r = random.Random(seed)
    return [[(k, i, r.choice([0.0, 0.3, 0.5, 0.66, 0.8, 0.9]), r.random() < 0.7, r.random() < 0.5) for i in range(r.randint(1, 7))] for k in range(n)]


def test_early_stops(spark):
    data = groups(3)
    df = spark.createDataFrame([x for g_ in data for x in g_], "k int, seq int, conf double, found boolean, dated boolean")
    got = {name: {r.k: r.seq for r in f.collect()} for name, f in (
        ("size", select.size_winner(df, ["k"])), ("dot", select.dot_winner(df, ["k"], dated="dated")), ("roi", select.roi_winner(df, ["k"], score="conf", ok="dated")),
    )}
    for rows in data:
        best, size, dot, roi = 0.0, None, None, None
        for k, i, c, found, _ in rows:
            if found and c > best:
                best, size = c, i
                if c >= 0.84:
                    break
        best = 0.0
        for k, i, c, found, dated in rows:
            if found and c > 0:
                if c > best:
                    best, dot = c, i
                if dated and c >= 0.76:
                    break
        best = -1.0
        for k, i, c, _, ok in rows:
            if c > best:
                best, roi = c, i
                if ok and c >= 0.65:
                    break
        k = rows[0][0]
        assert (got["size"].get(k), got["dot"].get(k), got["roi"].get(k)) == (size, dot, roi)


def iou(a, b):
    w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    inter = max(0, w) * max(0, h)
    return inter / (a[2] * a[3] + b[2] * b[3] - inter)


def test_greedy_and_peaks(spark):
    r = random.Random(5)
    data = [(k, i, r.choice([0.2, 0.5, 0.9]), (r.randint(0, 40), r.randint(0, 40), r.randint(5, 30), r.randint(5, 30))) for k in range(60) for i in range(r.randint(1, 9))]
    df = spark.createDataFrame(data, "k int, idx int, score double, box struct<x:int,y:int,w:int,h:int>")
    got = {}
    for x in boxes.greedy(df, ["k"], 0.3, limit=3).orderBy("k", "rank").collect():
        got.setdefault(x.k, []).append(x.idx)
    for k in range(60):
        kept = []
        for _, i, _, b in sorted((x for x in data if x[0] == k), key=lambda x: (-x[2], x[1])):
            if len(kept) < 3 and all(iou(b, c) <= 0.3 for _, c in kept):
                kept.append((i, b))
        assert got[k] == [i for i, _ in kept]
    signals = [[r.randint(-2, 9) * 1.0 for _ in range(r.randint(0, 12))] for _ in range(80)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(signals)], "i int, s array<double>")
    for x in df.select("i", "s", boxes.peaks(F.col("s"), 3, F.lit(2)).alias("p")).collect():
        left, want = list(x.s), []
        while len(want) < 3 and left and max(left) > 0:
            c = left.index(max(left))
            want.append(c)
            for j in range(max(0, c - 2), min(len(left), c + 2)):
                left[j] = 0.0
        assert list(x.p) == want


def test_signals(spark):
    r = random.Random(8)
    data = [(k, i, float(r.randint(0, 200))) for k in range(40) for i in range(r.randint(1, 15))]
    df = spark.createDataFrame(data, "k int, x int, v double")
    got = {x.k: (x.start, x.end) for x in signal.best_range(df, ["k"], "x", "v", 3, 5).collect()}
    borders = {x.k: x.border for x in signal.border(df, ["k"], "x", "v").collect()}
    steps = {(x.k, x.x): x.s for x in df.select("k", "x", signal.zero_padded_step(F.col("v"), ["k"], "x").alias("s")).collect()}
    for k in range(40):
        v = [x for a, _, x in data if a == k]
        best, want = -1.0, (0, len(v))
        for s in range(len(v)):
            for e in range(s + 3, min(len(v), s + 5) + 1):
                if sum(v[s:e]) > best:
                    best, want = sum(v[s:e]), (s, e)
        assert got[k] == want
        seen, want = False, None
        for i, x in enumerate(v):
            seen |= x > 80
            if seen and x < 50:
                want = i
                break
        assert borders[k] == want
        smooth = np.convolve(v, np.ones(7) / 7, mode="full")[3 : 3 + len(v)]
        for i in range(len(v) - 1):
            assert abs(steps[k, i] - (smooth[i + 1] - smooth[i])) < 1e-9


def test_circle_and_ranges(spark):
    rng = np.random.default_rng(4)
    data = []
    for k in range(30):
        cx, cy, rad = rng.uniform(-50, 50, 2).tolist() + [rng.uniform(5, 80)]
        data += [(k, cx + rad * np.cos(a) + rng.normal(0, 0.2), cy + rad * np.sin(a) + rng.normal(0, 0.2)) for a in rng.uniform(0, 6.28, 8)]
    data += [(99, float(i), 2.0 * i) for i in range(4)]
    df = spark.createDataFrame([(k, float(x), float(y)) for k, x, y in data], "k int, x double, y double")
    got = {r.k: r for r in signal.circle_fit(df, ["k"]).collect()}
    for k in range(30):
        p = np.array([(x, y) for a, x, y in data if a == k])
        d, e, f = np.linalg.lstsq(np.c_[p, np.ones(len(p))], (p**2).sum(1), rcond=None)[0]
        assert np.allclose([got[k].cx, got[k].cy, got[k].radius], [d / 2, e / 2, np.sqrt(f + d * d / 4 + e * e / 4)], atol=1e-6)
    assert got[99].radius is None


def test_resumed_runs_keep_their_details(spark):
    images, done = spark.createDataFrame([("a",), ("b",)], "image string"), spark.createDataFrame([("a", 1), ("x", 2)], "image string, v int")
    left, kept, rows = etl.pending_with(images, done, spark.createDataFrame([("a", "d1"), ("a", "d2"), ("x", "d3")], "image string, d string"), "image")
    assert [r.image for r in left.collect()] == ["b"] and [r.v for r in kept.collect()] == [1] and sorted(r.d for r in rows.collect()) == ["d1", "d2"]


def test_spans_of_other_lengths(spark):
    rng = random.Random(3)
    data = [(k, i, float(rng.randint(0, 9))) for k in range(30) for i in range(rng.randint(1, 40))]
    df = spark.createDataFrame(data, "k int, x int, v double")
    for least, most in ((1, 1), (2, 9), (5, 40), (50, 60)):
        got = {x.k: (x.start, x.end) for x in signal.best_range(df, ["k"], "x", "v", least, most).collect()}
        for k in range(30):
            v = [x for a, _, x in data if a == k]
            spans = [(-sum(v[s:e]), s, e) for s in range(len(v)) for e in range(s + least, min(len(v), s + most) + 1)]
            assert got[k] == (min(spans)[1:] if spans else (0, len(v)))


def test_merge_tables_and_detector(spark):
    assert boxes.merged(pd.DataFrame([(0, 0, 10, 10), (12, 0, 10, 10), (300, 300, 5, 5)], columns=list("xywh")), 640, 480) == [(0, 0, 22, 10), (300, 300, 5, 5)]
    images = spark.range(200).withColumnRenamed("id", "image")
    parts = {r.split: r["count"] for r in etl.split(images, "image", 0.15, 3).groupBy("split").count().collect()}
    assert parts == {"val": 30, "train": 170}
    raw = spark.createDataFrame([(1, 0, 320.0, 320.0, 100.0, 50.0, [0.1, 0.9, 0.9]), (1, 1, 322.0, 320.0, 100.0, 50.0, [0.0, 0.8, 0.0]), (1, 2, 100.0, 100.0, 4.0, 4.0, [0.9, 0.0, 0.0]), (1, 3, 320.0, 320.0, 90.0, 50.0, [0.1, 0.0, 0.0])], "image int, idx int, cx double, cy double, w double, h double, scores array<double>")
    found = providers.decoded(raw, F.lit(640), F.lit(640), ["Brand", "DOT", "Size"]).collect()
    assert [(r.idx, r.label, tuple(r.box)) for r in found] == [(0, "DOT", (270, 295, 100, 50))]
    one = spark.createDataFrame([("1,2,3,4",), ("1,2,3",), ("a,2,3,4",), (None,)], "s string").select(g.parse_box(F.col("s")).alias("b")).collect()
    assert [r.b and tuple(r.b) for r in one] == [(1, 2, 3, 4), None, None, None]
