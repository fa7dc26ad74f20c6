"""Greedy choices among boxes and peaks of one image, as folds over sorted arrays, and the merge of near boxes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimlight.functions.geometry import iou


def greedy(rows: DataFrame, keys: Sequence[str], overlap: float, limit: int | None = None, score: str = "score", idx: str = "idx", b: str = "box") -> DataFrame:
    """Per key the boxes that overlap no better one by more than `overlap`, up to `limit`; equal scores by idx."""
    one = F.struct((-F.col(score)).alias("neg"), F.col(idx).alias("idx"), F.col(b).alias("box"))
    ranked = F.array_sort(F.collect_list(one))

    def step(kept: Column, x: Column) -> Column:
        free = ~F.exists(kept, lambda k: iou(k["box"], x["box"]) > overlap)
        free = free & (F.size(kept) < limit) if limit else free
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    grouped = rows.groupBy(*keys).agg(ranked.alias("_r"))
    kept = F.aggregate("_r", F.slice("_r", 1, 0), step)
    out = grouped.select(*keys, F.posexplode(kept).alias("rank", "_k"))
    return out.select(*keys, (F.col("rank") + 1).alias("rank"), F.col("_k.idx").alias(idx), (-F.col("_k.neg")).alias(score), F.col("_k.box").alias(b))


def peaks(signal: Column, limit: int, radius: Column) -> Column:
    """Places of the largest positive values, each at least a radius apart: x is taken out by a peak k if k - r <= x < k + r."""
    placed = F.transform(signal, lambda v, i: F.struct((-v).alias("neg"), i.alias("x")))
    order = F.array_sort(F.filter(placed, lambda s: s["neg"] < 0))

    def step(kept: Column, s: Column) -> Column:
        free = ~F.exists(kept, lambda k: (s["x"] >= k - radius) & (s["x"] < k + radius))
        return F.when(free & (F.size(kept) < limit), F.concat(kept, F.array(s["x"]))).otherwise(kept)

    return F.aggregate(order, F.array().cast("array<int>"), step)


#: Images of up to so many boxes are merged together, boxes of more one image at a time; then, boxes looked at at once.
TOGETHER, BLOCK = 32, 512


def _near(a: Sequence[np.ndarray], b: Sequence[np.ndarray], width: int, height: int) -> np.ndarray:
    """Whether boxes (left, top, right, bottom) are near or beside each other."""
    gap_x = np.maximum(0, np.maximum(a[0], b[0]) - np.minimum(a[2], b[2]))
    gap_y = np.maximum(0, np.maximum(a[1], b[1]) - np.minimum(a[3], b[3]))
    tall, other = a[3] - a[1], b[3] - b[1]
    level = np.abs((a[1] + tall // 2) - (b[1] + other // 2)) < np.maximum(tall, other)
    return ((gap_x < width // 40) & level) | ((gap_y < height // 60) & (gap_x < width // 12))


def _one(edges: np.ndarray, alive: np.ndarray, width: int, height: int) -> None:
    """Merges one image's boxes (columns of left, top, right, bottom) in place."""
    grown = True
    while grown:
        grown, rest = False, np.flatnonzero(alive)
        while len(rest):
            head, rest, at = rest[0], rest[1:], 0
            while at < len(rest):
                # a box that grows is compared anew with the boxes after the one it took
                some = rest[at : at + BLOCK]
                found = np.flatnonzero(_near(edges[:, head, None], edges[:, some], width, height))
                if not len(found):
                    at += len(some)
                    continue
                at += int(found[0])
                other, grown = rest[at], True
                edges[:2, head], edges[2:, head] = np.minimum(edges[:2, head], edges[:2, other]), np.maximum(edges[2:, head], edges[2:, other])
                alive[other] = False
                at += 1
            rest = rest[alive[rest]]


def _many(edges: np.ndarray, alive: np.ndarray, width: int, height: int) -> None:
    """Merges the boxes of images with equally many boxes in place: edges by side, box and image, alive by box and image."""
    n, todo = len(alive), np.arange(alive.shape[1])
    while len(todo):
        now, left, grown = edges[:, :, todo], alive[:, todo], np.zeros(len(todo), bool)
        for i in range(n):
            for j in range(i + 1, n):
                hit = left[i] & left[j] & _near(now[:, i], now[:, j], width, height)
                if hit.any():
                    now[:2, i], now[2:, i] = np.where(hit, np.minimum(now[:2, i], now[:2, j]), now[:2, i]), np.where(hit, np.maximum(now[2:, i], now[2:, j]), now[2:, i])
                    left[j] &= ~hit
                    grown |= hit
        edges[:, :, todo], alive[:, todo] = now, left
        todo = todo[grown]


def merged(boxes: pd.DataFrame, width: int, height: int) -> list[tuple[int, int, int, int]]:
    """Boxes united with every later one that is near or beside them, again and again until none is."""
    x, y, w, h = (boxes[c].to_numpy(np.int64) for c in "xywh")
    edges, alive = np.stack([x, y, x + w, y + h]), np.ones(len(x), bool)
    _one(edges, alive, width, height)
    return [(a, b, c - a, d - b) for a, b, c, d in edges[:, alive].T.tolist()]


def merge_nearby(rows: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """Merged boxes per image (key, idx, x, y, w, h), as `merged` has them in the order of idx.

    A box without one of its numbers stays as it is.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, counts = b.column(1).flatten(), b.column(1).value_lengths().to_numpy()
            sides = [found.field(i) for i in range(2, 6)]
            known = np.logical_and.reduce([s.is_valid().to_numpy(zero_copy_only=False) for s in sides])
            x, y, w, h = (s.fill_null(0).to_numpy().astype(np.int64) for s in sides)
            edges, alive, first = np.stack([x, y, x + w, y + h]), known.copy(), np.cumsum(counts) - counts
            for n in np.unique(counts).tolist():
                at = first[counts == n] + np.arange(n)[:, None]
                for k in range(at.shape[1]) if n > TOGETHER else [slice(None)]:
                    part, left = edges[:, at[:, k]], alive[at[:, k]]
                    (_one if n > TOGETHER else _many)(part, left, width, height)
                    edges[:, at[:, k]], alive[at[:, k]] = part, left
            kept = np.flatnonzero(alive | ~known)
            image = np.repeat(np.arange(len(counts)), counts)[kept]
            place = np.arange(len(kept)) - np.searchsorted(image, image)
            done = [edges[0], edges[1], edges[2] - edges[0], edges[3] - edges[1]]
            done = [pc.if_else(pa.array(known[kept]), pa.array(new[kept]).cast(pa.int32()), old.take(pa.array(kept))) for new, old in zip(done, sides, strict=True)]
            yield pa.record_batch([b.column(0).take(pa.array(image)), pa.array(place, pa.int32()), *done], [key, "idx", "x", "y", "w", "h"])

    kind = rows.schema[key].dataType.simpleString()
    order = F.struct(F.col("idx").isNull().alias("none"), "idx", *(F.col(c).cast("int").alias(c) for c in "xywh"))
    images = rows.groupBy(key).agg(F.sort_array(F.collect_list(order)).alias("boxes"))
    return images.mapInArrow(run, f"{key} {kind}, idx int, x int, y int, w int, h int")
