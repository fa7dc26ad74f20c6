"""Boxes, angles and rings as column functions. A box is struct(x, y, w, h) of whole numbers."""

from __future__ import annotations

from decimal import Decimal, localcontext

from pyspark.sql import Column
from pyspark.sql import functions as F

from rimlight.functions.text import clamp01, once

ANGLE_PAD = 6.0
CORNERS = ((0.0, 0.0), (1.0, 0.0), (0.0, 1.0), (1.0, 1.0), (0.5, 0.5))
#: Weights by label of what a field may be read from; the other labels weigh 0.
SIZE_AFFINITY = {"SIZE": 1.0, "MODEL": 0.72, "BRAND": 0.56, "DOT": 0.10}
DOT_AFFINITY = {"DOT": 1.0, "MODEL": 0.12, "BRAND": 0.08, "SIZE": 0.05}


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))


def box_text(b: Column) -> Column:
    return F.concat_ws(",", b["x"], b["y"], b["w"], b["h"])


def parse_box(c: Column) -> Column:
    """A box from 'x,y,w,h'; null unless there are four whole numbers."""
    p = F.split(c, ",")
    n = [F.try_element_at(p, F.lit(i)).try_cast("int") for i in (1, 2, 3, 4)]
    ok = F.size(p) == 4
    for v in n:
        ok = ok & v.isNotNull()
    return F.when(ok, box(*n))


def iou(a: Column, b: Column) -> Column:
    """Shared area over joint area; 0 where either is empty."""
    w = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])).cast("double")
    h = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])).cast("double")
    both = a["w"].cast("double") * a["h"] + b["w"].cast("double") * b["h"] - w * h
    return F.when(both > 0, w * h / both).otherwise(0.0)


def clamp_rect(b: Column, width: Column, height: Column) -> Column:
    """The part of a box within 0,0..width,height; all zeros if there is none."""
    x0, y0 = F.greatest(b["x"], F.lit(0)), F.greatest(b["y"], F.lit(0))
    x1, y1 = F.least(b["x"] + b["w"], width), F.least(b["y"] + b["h"], height)
    some = (x1 > x0) & (y1 > y0)
    return F.when(some, box(x0, y0, x1 - x0, y1 - y0)).otherwise(box(F.lit(0), F.lit(0), F.lit(0), F.lit(0)))


def clamp_corners(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column) -> Column:
    """Corners pulled inside, at least one pixel apart, as struct(x0, y0, x1, y1)."""
    a, b = F.greatest(F.lit(0), F.least(x0, width - 1)), F.greatest(F.lit(0), F.least(y0, height - 1))
    return F.struct(a.alias("x0"), b.alias("y0"), F.greatest(a + 1, F.least(x1, width)).alias("x1"), F.greatest(b + 1, F.least(y1, height)).alias("y1"))


def expand_corners(c: Column, width: Column, height: Column, margin: float = 0.04) -> Column:
    """Corners moved out by a share of the box's sides (halves to even), then clamped."""
    dx, dy = F.bround((c["x1"] - c["x0"]) * F.lit(margin)).cast("int"), F.bround((c["y1"] - c["y0"]) * F.lit(margin)).cast("int")
    return clamp_corners(c["x0"] - dx, c["y0"] - dy, c["x1"] + dx, c["y1"] + dy, width, height)


def _arcs(steps: int) -> list[Decimal]:
    """The arc tangents of 0, 1/steps, ... 1 to 24 places."""
    out = [Decimal(0)]
    with localcontext() as c:
        c.prec = 40
        for k in range(steps):
            z, i, arc = Decimal(steps) / (steps * steps + k * (k + 1)), 1, out[-1]
            power = z
            while abs(power) > Decimal(10) ** -35:
                arc, power, i = arc + power / i, -power * z * z, i + 2
            out.append(arc)
        return [x.quantize(Decimal(10) ** -24) for x in out]


_STEPS, _PLACES = 16, "decimal(26,24)"
_ARCS = _arcs(_STEPS)


def exact_atan2(dy: Column, dx: Column) -> Column:
    """atan2 rounded from 24 places, for multiples of 1/64 below 100,000; others as the engine has them.

    The engine's own last bit may be wrong, and differs between platforms.
    """

    def made(p: Column) -> Column:
        lo, hi = p["lo"], p["hi"]
        k = F.round(lo / hi * _STEPS).cast("int")
        # tan(a - b) = (x - y) / (1 + xy): the rest beyond the nearest step, in whole numbers but for one division
        rest = (_STEPS * lo - k * hi).cast("decimal(14,6)") / (_STEPS * hi + k * lo).cast("decimal(17,6)")
        arc = once(F.struct(rest.cast(_PLACES).alias("z"), k.alias("k")), series)
        arc = F.when(F.abs(dy) > F.abs(dx), F.lit(2 * _ARCS[-1]).cast(_PLACES) - arc).otherwise(arc)
        arc = F.when(dx < 0, F.lit(4 * _ARCS[-1]).cast(_PLACES) - arc).otherwise(arc).cast("double")
        return F.when(dy < 0, -arc).otherwise(arc)

    def series(p: Column) -> Column:
        steps = F.array(*(F.lit(x).cast(_PLACES) for x in _ARCS))
        z = p["z"].cast("double")
        q, tail = z * z, F.lit(0.0)
        for i in (13, 11, 9, 7, 5, 3):
            tail = q * (tail + (1.0 if i % 4 == 1 else -1.0) / i)
        return F.element_at(steps, p["k"] + 1) + p["z"] + (z * tail).cast(_PLACES)

    sides = F.abs(dx), F.abs(dy)
    fits = (F.greatest(*sides) > 0) & (F.greatest(*sides) < 100_000) & (dx * 64 == F.rint(dx * 64)) & (dy * 64 == F.rint(dy * 64))
    return F.when(fits, once(F.struct(F.least(*sides).alias("lo"), F.greatest(*sides).alias("hi")), made)).otherwise(F.atan2(dy, dx))


def angle(dx: Column, dy: Column, exact: bool = False) -> Column:
    """Direction of a point from the center, in [0, 360). All are turned once, so that all are rounded alike."""
    return (F.degrees((exact_atan2 if exact else F.atan2)(dy, dx)) + 360.0) % 360.0


def normal_angle(a: Column) -> Column:
    return F.pmod(a, F.lit(360.0))


def _points(b: Column) -> list[tuple[Column, Column]]:
    return [(b["x"] + b["w"] * F.lit(i), b["y"] + b["h"] * F.lit(j)) for i, j in CORNERS]


def angle_range(b: Column, cx: Column, cy: Column) -> Column:
    """struct(start, end): the smallest arc that holds a box's corners and middle, padded; the first largest gap is left out.

    Which of two equal gaps is the larger one is a matter of their last bits (boxes in line with the center): there, angles
    are computed anew, correctly rounded.
    """
    n = len(CORNERS)

    def arc(start: Column, end: Column) -> Column:
        end = F.when(end <= start, end + 360.0).otherwise(end)
        return F.struct(((start - ANGLE_PAD + 720.0) % 360.0).alias("start"), ((end + ANGLE_PAD + 720.0) % 360.0).alias("end"))

    def gaps(a: Column) -> Column:
        return F.array(*((a[i + 1] if i + 1 < n else a[0] + 360.0) - a[i] for i in range(n)))

    def sure(a: Column) -> Column:
        places = F.array(*(F.struct((x - cx).alias("x"), (y - cy).alias("y")) for x, y in _points(b)))
        exact = F.sort_array(F.transform(places, lambda p: angle(p["x"], p["y"], exact=True)))
        return F.when(once(F.sort_array(gaps(a), False), lambda x: x[0] - x[1] < 1e-9), exact).otherwise(a)

    def around(a: Column) -> Column:
        at = once(gaps(a), lambda x: F.array_position(x, F.array_max(x)).cast("int") - 1)
        return once(at, lambda i: arc(a[(i + 1) % n], a[i]))

    return once(once(F.sort_array(F.array(*(angle(x - cx, y - cy) for x, y in _points(b)))), sure), around)


def radii(b: Column, cx: Column, cy: Column) -> Column:
    return F.array(*(F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) for x, y in _points(b)))


def annulus_score(b: Column, cx: Column, cy: Column, inner: Column, outer: Column) -> Column:
    """How well a box lies in a ring: its share in the widened band, and how near its middle is to the band's middle."""
    r = radii(b, cx, cy)
    lo, hi = F.array_min(r), F.array_max(r)
    overlap = F.greatest(F.lit(0.0), F.least(hi, outer * 1.04) - F.greatest(lo, inner * 0.92))
    share = clamp01(overlap / F.greatest(F.lit(1.0), hi - lo))
    middle = (F.element_at(r, len(CORNERS)) - inner) / F.greatest(F.lit(1.0), outer - inner)
    return F.when(outer <= inner, 1.0).otherwise(clamp01(0.65 * share + 0.35 * clamp01(1.0 - F.abs(middle - 0.52) / 0.52)))


def radius_range(b: Column, cx: Column, cy: Column, inner: Column, outer: Column, narrow: bool = False) -> Column:
    """struct(min, max): the ring that a box covers, from the quartiles of a 5 x 5 grid of its points."""
    # ten squared distances are enough for the grid; those within the squared bounds are sorted as they are
    across, down = ([F.pow(b[p] + b[s] * F.lit(i / 4) - c, F.lit(2)) for i in range(5)] for p, s, c in (("x", "w", cx), ("y", "h", cy)))
    squares = F.transform(F.array(F.struct(F.array(*across).alias("x"), F.array(*down).alias("y"))), lambda g: F.array(*(F.sqrt(F.element_at(g["x"], i + 1) + F.element_at(g["y"], j + 1)) for j in range(5) for i in range(5))))[0]
    r = F.sort_array(F.filter(squares, lambda v: (v >= inner * 0.90) & (v <= outer * 1.05)))
    r = F.transform(F.array(r), lambda v: F.when(F.size(v) == 0, F.array((inner + outer) * 0.5)).otherwise(v))[0]
    # bound to a lambda's variables, the sorted radii are made once and not for each quartile
    thirds = F.transform(F.array(r), lambda v: F.struct(*(F.element_at(v, F.shiftright(F.size(v) * k, 2) + 1).alias(f"q{k}") for k in (1, 2, 3))))
    return F.transform(thirds, lambda q: _ring(q["q1"], q["q2"], q["q3"], inner, outer, narrow))[0]


def _ring(q1: Column, q2: Column, q3: Column, inner: Column, outer: Column, narrow: bool) -> Column:
    """The ring around the quartiles of radii, at least a share of the band wide."""
    band = F.greatest(F.lit(1.0), outer - inner)
    margin, least = (0.05, 0.10) if narrow else (0.08, 0.16)
    lo, hi = F.greatest(inner, q1 - band * margin), F.least(outer, q3 + band * margin)
    short = (hi - lo) < band * least
    lo2, hi2 = F.greatest(inner, q2 - band * least * 0.5), F.least(outer, q2 + band * least * 0.5)
    return F.struct(F.when(short, lo2).otherwise(lo).alias("min"), F.when(short, hi2).otherwise(hi).alias("max"))


def band_rect(width: Column, height: Column, inner: Column, outer: Column, lo: Column, hi: Column) -> Column:
    """The rows of an unwrapped ring that hold the radii from lo to hi, outermost first."""
    band = F.greatest(F.lit(1.0), outer - inner)
    a = F.floor((1.0 - clamp01((hi - inner) / band)) * height).cast("int")
    b = F.ceil((1.0 - clamp01((lo - inner) / band)) * height).cast("int")
    a = F.least(F.greatest(a, F.lit(0)), F.greatest(F.lit(0), height - 1))
    b = F.least(F.greatest(b, a + 1), height)
    return box(F.lit(0), a, width, b - a)


def sector_columns(start: Column, end: Column, width: Column) -> Column:
    """struct(x, w): the columns of an unwrapped ring, repeated once past its seam, from one angle to another; all if they are null."""
    a, b = normal_angle(start), normal_angle(end)
    b = F.when(F.abs(b - a) < 1e-6, a + 360.0).when(b <= a, b + 360.0).otherwise(b)
    per = width / F.lit(360.0)
    x0 = F.least(F.greatest(F.floor(a * per).cast("int"), F.lit(0)), F.greatest(F.lit(0), 2 * width - 1))
    x1 = F.greatest(F.least(F.ceil(b * per).cast("int"), 2 * width), x0 + 1)
    return F.struct(x0.cast("int").alias("x"), (x1 - x0).cast("int").alias("w"))


def local_ring(b: Column, cx: Column, cy: Column, inner: Column, outer: Column, width: Column, height: Column, narrow: bool = False) -> Column:
    """Where a box lies on an unwrapped ring: struct(start, end, min, max, x, y, w, h), from its angles and radii.

    x and w are columns of the ring repeated past its seam, y and h its rows.
    """
    arc, ring = angle_range(b, cx, cy), radius_range(b, cx, cy, inner, outer, narrow)

    def made(p: Column) -> Column:
        across = sector_columns(p["a"]["start"], p["a"]["end"], width)
        return F.transform(F.array(F.struct(across.alias("s"), band_rect(width, height, inner, outer, p["r"]["min"], p["r"]["max"]).alias("band"))), lambda q: F.struct(
            p["a"]["start"].alias("start"), p["a"]["end"].alias("end"), p["r"]["min"].alias("min"), p["r"]["max"].alias("max"), q["s"]["x"].alias("x"), q["band"]["y"].alias("y"), q["s"]["w"].alias("w"), q["band"]["h"].alias("h")))[0]

    return F.transform(F.array(F.struct(arc.alias("a"), ring.alias("r"))), made)[0]


def letterbox(width: Column, height: Column, target: int = 640) -> Column:
    """struct(scale, pad_x, pad_y, w, h) of an image fitted into a square."""
    scale = F.least(F.lit(float(target)) / F.greatest(F.lit(1), width), F.lit(float(target)) / F.greatest(F.lit(1), height))
    w, h = (F.greatest(F.lit(1), F.round(x * scale).cast("int")) for x in (width, height))
    return F.struct(scale.alias("scale"), F.floor((target - w) / 2).cast("int").alias("pad_x"), F.floor((target - h) / 2).cast("int").alias("pad_y"), w.alias("w"), h.alias("h"))


def from_letterbox(cx: Column, cy: Column, w: Column, h: Column, fit: Column, width: Column, height: Column) -> Column:
    """A box by center and sides in the square, mapped back to the image."""

    def at(v: Column, pad: Column) -> Column:
        return F.round((v - pad) / fit["scale"]).cast("int")

    x0 = F.least(F.greatest(at(cx - w * 0.5, fit["pad_x"]), F.lit(0)), F.greatest(F.lit(0), width - 1))
    y0 = F.least(F.greatest(at(cy - h * 0.5, fit["pad_y"]), F.lit(0)), F.greatest(F.lit(0), height - 1))
    x1 = F.least(F.greatest(at(cx + w * 0.5, fit["pad_x"]), x0 + 1), width)
    y1 = F.least(F.greatest(at(cy + h * 0.5, fit["pad_y"]), y0 + 1), height)
    return box(x0, y0, x1 - x0, y1 - y0)


def class_argmax(scores: Column) -> Column:
    """struct(cls, score): the first class with the largest score above 0; cls -1 if none is."""
    best = F.array_max(scores)
    some = best > 0
    return F.struct(F.when(some, F.array_position(scores, best).cast("int") - 1).otherwise(-1).alias("cls"), F.when(some, best).otherwise(0.0).alias("score"))


def affinity(label: Column, weights: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for name, w in weights.items():
        out = F.when(label == name, w).otherwise(out)
    return out


def crop_rect(width: Column, height: Column, top: Column, bottom: Column) -> Column:
    """Rows from top to bottom per cent, at least one."""
    y0 = F.least(F.greatest(F.round(height * (top / 100.0)).cast("int"), F.lit(0)), F.greatest(F.lit(0), height - 1))
    y1 = F.least(F.greatest(F.round(height * (bottom / 100.0)).cast("int"), y0 + 1), height)
    return box(F.lit(0), y0, width, y1 - y0)


def crop_percents(top: Column, bottom: Column) -> Column:
    """struct(top, bottom) at least one apart: top is set first and stays below bottom, then bottom above top."""
    t = F.least(top, bottom - 1)
    return F.struct(t.alias("top"), F.greatest(bottom, t + 1).alias("bottom"))


def to_yolo(b: Column, width: Column, height: Column) -> Column:
    """struct(cx, cy, w, h) as shares of the image's sides, from struct(x, y, w, h)."""
    return F.struct(((b["x"] + b["w"] / 2.0) / width).alias("cx"), ((b["y"] + b["h"] / 2.0) / height).alias("cy"), (b["w"] / width).alias("w"), (b["h"] / height).alias("h"))


def structure_score(field: str, count: Column, aspect: Column, avg_height: Column, jitter: Column, gap_mean: Column, gap_std: Column, slender: Column, wide: Column, rows: Column, quality: Column) -> Column:
    """How much a run of components looks like a line of the field's text; gap_mean is null for a run of one."""

    def near(x: Column, at: float, span: float) -> Column:
        return 1.0 - F.least(F.abs(x - at) / span, F.lit(1.0))

    size = field == "size"
    counted, shaped = (near(count, 8.0, 6.0), near(aspect, 4.2, 3.6)) if size else (near(count, 6.0, 8.0), near(aspect, 3.0, 3.0))
    tall = F.least(avg_height / F.greatest(F.lit(1.0), rows * 0.35), F.lit(1.0))
    aligned = 1.0 - F.least(jitter / F.greatest(F.lit(6.0), avg_height * 0.35), F.lit(1.0))
    spaced = F.when(gap_mean.isNull(), 0.0).otherwise(1.0 - F.least(gap_std / F.greatest(F.lit(3.0), gap_mean + 1.0), F.lit(1.0)))
    if not size:
        return clamp01(0.32 * counted + 0.24 * shaped + 0.16 * aligned + 0.10 * spaced + 0.18 * quality)
    anchors, digits = F.least(slender / 2.0, F.lit(1.0)), F.least(wide / 4.0, F.lit(1.0))
    return clamp01(0.24 * counted + 0.18 * shaped + 0.16 * aligned + 0.14 * spaced + 0.14 * anchors + 0.06 * digits + 0.08 * tall)


def flat_score(aspect: Column, area: Column, image_area: Column) -> Column:
    """A proposal's score by shape and share of the image."""
    return clamp01(F.least(aspect, F.lit(10.0)) / 10.0 * 0.6 + F.least(area / image_area * 8.0, F.lit(0.4)))
