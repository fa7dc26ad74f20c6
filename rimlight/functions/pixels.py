"""Pixel kernels on rasters as numpy code, and the batch functions that run them next to Spark's image rows.

Everything that decides (which circle, which candidate, which text) is done in columns elsewhere; here pixels become
numbers or other pixels. Filters follow the usual definitions (reflected borders, BT.601 gray); values agree with
other libraries to rounding, not bit by bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

RASTER = "origin string, height int, width int, data binary"


def gray(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """A raster of bytes (blue, green, red) as gray."""
    a = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    if channels == 1:
        return a[:, :, 0].copy()
    return np.rint(a[:, :, :3] @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def _windows(a: np.ndarray, size: int, axis: int) -> np.ndarray:
    pad = [(0, 0), (0, 0)]
    pad[axis] = ((size - 1) // 2, size // 2)
    return np.lib.stride_tricks.sliding_window_view(np.pad(a, pad, mode="edge"), size, axis)


def dilate(a: np.ndarray, w: int, h: int) -> np.ndarray:
    return _windows(_windows(a, max(1, w), 1).max(-1), max(1, h), 0).max(-1)


def erode(a: np.ndarray, w: int, h: int) -> np.ndarray:
    return _windows(_windows(a, max(1, w), 1).min(-1), max(1, h), 0).min(-1)


def close(a: np.ndarray, w: int, h: int) -> np.ndarray:
    return erode(dilate(a, w, h), w, h)


def opened(a: np.ndarray, w: int, h: int) -> np.ndarray:
    return dilate(erode(a, w, h), w, h)


def blackhat(a: np.ndarray, w: int, h: int) -> np.ndarray:
    return close(a, w, h) - a


def blur(a: np.ndarray, size: int) -> np.ndarray:
    """Gaussian of an odd size, with the usual sigma for it."""
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    k = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    k /= k.sum()
    pad = np.pad(a.astype(float), size // 2, mode="reflect") if min(a.shape) > size // 2 else np.pad(a.astype(float), size // 2, mode="edge")
    view = np.lib.stride_tricks.sliding_window_view
    return view(view(pad, size, 1) @ k, size, 0) @ k


def otsu(a: np.ndarray) -> int:
    """The threshold that parts the histogram with the greatest variance between its sides."""
    p = np.bincount(a.ravel(), minlength=256) / a.size
    w, m = np.cumsum(p), np.cumsum(p * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w - m) ** 2 / (w * (1 - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def adaptive(a: np.ndarray, size: int = 31, below: float = 7) -> np.ndarray:
    """White where a pixel is above its blurred surrounding less a constant."""
    return np.where(a > np.rint(blur(a, size)) - below, 255, 0).astype(np.uint8)


def clahe(a: np.ndarray, limit: float = 3.0, tiles: int = 8) -> np.ndarray:
    """Equalization by tiles with clipped histograms, blended between the tiles' middles."""
    h, w = a.shape
    th, tw = -(-h // tiles), -(-w // tiles)
    full = np.pad(a, ((0, th * tiles - h), (0, tw * tiles - w)), mode="symmetric" if min(h, w) > max(th * tiles - h, tw * tiles - w) else "edge")
    maps = np.empty((tiles, tiles, 256))
    cap = max(1, int(limit * th * tw / 256))
    for i in range(tiles):
        for j in range(tiles):
            hist = np.bincount(full[i * th : (i + 1) * th, j * tw : (j + 1) * tw].ravel(), minlength=256)
            over = int(np.maximum(hist - cap, 0).sum())
            hist = np.minimum(hist, cap) + over // 256
            hist[: 256 : max(1, 256 // (over % 256))][: over % 256] += 1 if over % 256 else 0
            maps[i, j] = np.minimum(np.rint(np.cumsum(hist) * 255 / (th * tw)), 255)
    y, x = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]

    def at(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return maps[np.clip(r, 0, tiles - 1)[:, None], np.clip(c, 0, tiles - 1)[None, :], a]

    top = at(y0, x0) * (1 - fx) + at(y0, x0 + 1) * fx
    low = at(y0 + 1, x0) * (1 - fx) + at(y0 + 1, x0 + 1) * fx
    return np.rint(top * (1 - fy) + low * fy).astype(np.uint8)


def quality(a: np.ndarray) -> tuple[float, float, float]:
    """(score, sharpness as variance of the Laplacian, contrast as deviation) of a gray raster."""
    if not a.size:
        return 0.0, 0.0, 0.0
    p = np.pad(a.astype(float), 1, mode="reflect") if min(a.shape) > 1 else np.pad(a.astype(float), 1, mode="edge")
    sharp = float((p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:] - 4 * p[1:-1, 1:-1]).var())
    contrast = float(a.std())
    return float(np.clip(0.55 * min(sharp / 2500, 1) + 0.45 * min(contrast / 64, 1), 0, 1)), sharp, contrast


def sample(a: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Bilinear values at places; 0 outside."""
    h, w = a.shape
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    fy, fx = y - y0, x - x0
    p = np.pad(a.astype(float), 1)

    def at(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        return p[np.clip(r + 1, 0, h + 1), np.clip(c + 1, 0, w + 1)]

    return at(y0, x0) * (1 - fy) * (1 - fx) + at(y0, x0 + 1) * (1 - fy) * fx + at(y0 + 1, x0) * fy * (1 - fx) + at(y0 + 1, x0 + 1) * fy * fx


def resize(a: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of the covered cells when both sides shrink, else bilinear."""
    h, w = a.shape
    if height <= h and width <= w:
        def cover(n: int, m: int) -> np.ndarray:
            edges = np.linspace(0, n, m + 1)
            i = np.arange(n)
            return np.clip(np.minimum(edges[1:, None], i + 1) - np.maximum(edges[:-1, None], i), 0, None) * (m / n)

        return np.rint(cover(h, height) @ a @ cover(w, width).T).astype(np.uint8)
    y, x = (np.arange(height) + 0.5) * h / height - 0.5, (np.arange(width) + 0.5) * w / width - 0.5
    return np.rint(sample(a, *np.meshgrid(np.clip(y, 0, h - 1), np.clip(x, 0, w - 1), indexing="ij"))).astype(np.uint8)


def to_megapixels(a: np.ndarray, mega: float = 5.0) -> np.ndarray:
    """Resized to a number of pixels, unless it is within 2 per cent by side."""
    scale = np.sqrt(mega * 1e6 / max(1, a.size))
    if abs(scale - 1) < 0.02:
        return a
    return resize(a, max(1, int(np.floor(a.shape[0] * scale + 0.5))), max(1, int(np.floor(a.shape[1] * scale + 0.5))))


def unwrap(a: np.ndarray, cx: float, cy: float, inner: float, outer: float) -> np.ndarray:
    """The ring between two radii as a strip: angles to the right from 0 degrees, the outer edge on top."""
    if outer <= inner or not a.size:
        return np.zeros((0, 0), np.uint8)
    n, m = max(1440, int(round(outer * 2 * np.pi))), max(128, int(np.ceil(outer)))
    lo = int(np.clip(np.floor(inner * m / max(1.0, outer)), 0, max(0, m - 2)))
    r = np.arange(lo, m)[::-1] * outer / m
    t = np.arange(n) * 2 * np.pi / n
    return np.rint(sample(a, cy + r[:, None] * np.sin(t), cx + r[:, None] * np.cos(t))).astype(np.uint8)


def sector(strip: np.ndarray, start: float, end: float) -> np.ndarray:
    """The columns of a strip from one angle to another, past the seam where needed."""
    if not strip.size:
        return strip
    a, b = start % 360.0, end % 360.0
    b = a + 360.0 if abs(b - a) < 1e-6 else b + 360.0 if b <= a else b
    per, n = strip.shape[1] / 360.0, 2 * strip.shape[1]
    x0 = int(np.clip(np.floor(a * per), 0, n - 1))
    x1 = int(np.clip(np.ceil(b * per), x0 + 1, n))
    return np.hstack([strip, strip])[:, x0:x1]


def unwrap_inside(a: np.ndarray, cx: float, cy: float, inner: float, outer: float, margin: float = 0.02, height: int | None = None) -> np.ndarray:
    """The ring without a margin at both edges as a strip as long as its outer edge, the outer one on top."""
    wall = max(int(outer - inner), 1)
    height = max(220, min(420, 2 * wall)) if height is None else height
    far, near = int(outer - wall * margin), int(inner + wall * margin)
    t = np.arange(int(2 * np.pi * far)) * 2 * np.pi / max(1, int(2 * np.pi * far))
    r = np.linspace(far, near, height)[:, None]
    return np.rint(sample(a, cy + r * np.sin(t), cx + r * np.cos(t))).astype(np.uint8)


def energies(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of white by row and by column."""
    return a.sum(1) / 255.0, a.sum(0) / 255.0


def rays(a: np.ndarray, cx: int, cy: int, step: int = 2, count: int = 360) -> list[tuple[int, list[int], list[int]]]:
    """(angle number, radii, values) along rays from a center to the nearest edge less 10 pixels; for `last_drop` per ray."""
    h, w = a.shape
    far = min(cx, cy, w - cx, h - cy) - 10
    out, r = [], np.arange(10, far, step)
    for i in range(count if far >= 120 else 0):
        x, y = (np.rint(c + r * f(2 * np.pi * i / count)).astype(int) for c, f in ((cx, np.cos), (cy, np.sin)))
        ok = (x >= 0) & (x < w) & (y >= 0) & (y < h)
        if ok.sum() >= 20:
            out.append((i, r[ok].tolist(), a[y[ok], x[ok]].tolist()))
    return out


def borders(a: np.ndarray) -> list[tuple[int, list[tuple[int, int]], list[int]]]:
    """(scan number, places, values) along the middle lines from the four edges; for `border` per scan."""
    h, w = a.shape
    lines = [[(w // 2, y) for y in range(h)], [(w // 2, y) for y in range(h - 1, -1, -1)], [(x, h // 2) for x in range(w)], [(x, h // 2) for x in range(w - 1, -1, -1)]]
    return [(i, line, [int(a[y, x]) for x, y in line]) for i, line in enumerate(lines) if len(line) >= 50]


def circle_strength(edges: np.ndarray, cx: float, cy: float, radius: float, samples: int, start: float = 0.0, end: float = 360.0) -> float:
    """Mean edge strength along an arc, off the outermost pixels."""
    if radius <= 1 or samples < 16 or not edges.size:
        return 0.0
    t = np.radians(np.linspace(start, end, samples))
    x, y = np.rint(cx + radius * np.cos(t)).astype(int), np.rint(cy + radius * np.sin(t)).astype(int)
    ok = (x >= 1) & (y >= 1) & (x < edges.shape[1] - 1) & (y < edges.shape[0] - 1)
    return float(edges[y[ok], x[ok]].mean()) if ok.any() else 0.0


def labelled(mask: np.ndarray) -> list[np.ndarray]:
    """Connected regions (4 neighbours) of a mask as arrays of (y, x): runs of rows joined where they touch."""
    root: list[int] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    runs, last = [], []
    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], row.astype(np.int8), [0]])))
        now = []
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            i = len(root)
            root.append(i)
            for j, c, d in last:
                if a < d and c < b:
                    root[find(i)] = find(j)
            now.append((i, a, b))
            runs.append((i, y, a, b))
        last = now
    parts: dict[int, list] = {}
    for i, y, a, b in runs:
        parts.setdefault(find(i), []).append(np.stack([np.full(b - a, y), np.arange(a, b)], 1))
    return [np.concatenate(p) for p in parts.values()]


def foreground(a: np.ndarray) -> tuple[np.ndarray, bool]:
    """(mask, found): the dark region with the best 2 * radius + fill - distance from the middle, of at least 5% of the image; all white if none is."""
    step = max(1, round(a.shape[1] / 350))
    small = a[::step, ::step]
    smooth = np.rint(blur(small, 9)).astype(np.uint8)
    dark = np.where(smooth <= otsu(smooth), 255, 0).astype(np.uint8)
    h, w = small.shape
    dark = opened(close(dark, max(3, w // 30), max(3, h // 30)), max(3, w // 80), max(3, h // 80))
    side, best, kept = max(1.0, float(min(h, w))), -1.0, None
    for part in labelled(dark > 0):
        if len(part) < 0.05 * h * w:
            continue
        mid = (part.min(0) + part.max(0)) / 2
        radius = float(np.sqrt(((part - mid) ** 2).sum(1).max()))
        score = 2 * radius / side + len(part) / max(1.0, np.pi * radius**2) - float(np.hypot(*(mid - np.array([h, w]) / 2))) / side
        if score > best:
            best, kept = score, part
    if kept is None:
        return np.full(a.shape, 255, np.uint8), False
    mask = np.zeros((h, w), np.uint8)
    for y in np.unique(kept[:, 0]):
        xs = kept[kept[:, 0] == y, 1]
        mask[y, xs.min() : xs.max() + 1] = 255
    return np.repeat(np.repeat(mask, step, 0), step, 1)[: a.shape[0], : a.shape[1]], True


def whitened(a: np.ndarray) -> tuple[np.ndarray, bool]:
    """A gray raster with all but its foreground white."""
    mask, found = foreground(a)
    return np.where(mask > 0, a, 255).astype(np.uint8), found


def variants(a: np.ndarray, aggressive: bool = False) -> list[tuple[str, np.ndarray]]:
    """The forms in which a region is read, in order."""
    if a.shape[0] < 280:
        scale = max(2.0, 180 / max(1, a.shape[0])) if a.shape[0] < 180 else 1.5
        a = resize(a, int(round(a.shape[0] * scale)), int(round(a.shape[1] * scale)))
    even = clahe(a)
    hat = blackhat(even, max(17, a.shape[1] // 14), max(5, a.shape[0] // 5))
    cut = adaptive(even)
    out = [("gray", a), ("clahe", even), ("blackhat", hat), ("otsu", np.where(even > otsu(even), 255, 0).astype(np.uint8)), ("adaptive", cut), ("adaptive_inv", 255 - cut)]
    return out + [("blackhat_inv", 255 - hat)] * aggressive


def over_images(images: DataFrame, kernel: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """Runs a kernel on each image row (origin, height, width, nChannels, data): its tuples become rows after origin.

    Rows come in Arrow batches and are taken one raster at a time; unreadable images (height -1) give no row.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.height > 0:
                    found = kernel(gray(r.data, r.height, r.width, r.nChannels))
                    yield pd.DataFrame([(r.origin, *x) for x in found], columns=["origin", *names])

    return images.select("origin", "height", "width", "nChannels", "data").mapInPandas(run, f"origin string, {schema}")


def qualities(images: DataFrame) -> DataFrame:
    return over_images(images, lambda a: [quality(a)], "score double, sharpness double, contrast double")


def whitened_images(images: DataFrame, mega: float = 5.0) -> DataFrame:
    """Gray rasters with white backgrounds at a common size."""

    def kernel(a: np.ndarray) -> list[tuple]:
        out, found = whitened(a)
        out = to_megapixels(out, mega)
        return [(out.shape[0], out.shape[1], found, out.tobytes())]

    return over_images(images, kernel, "height int, width int, found boolean, data binary")


def all_variants(images: DataFrame, aggressive: bool = False) -> DataFrame:
    """One row per image and form, with seq in the order in which they are read."""
    return over_images(images, lambda a: [(i, n, v.shape[0], v.shape[1], v.tobytes()) for i, (n, v) in enumerate(variants(a, aggressive))], "seq int, variant string, height int, width int, data binary")


def border_signals(images: DataFrame) -> DataFrame:
    """(origin, scan, x, px, py, value): the values that `signal.border` reads after smoothing."""
    return over_images(images, lambda a: [(i, k, *p, float(v)) for i, places, values in borders(a) for k, (p, v) in enumerate(zip(places, values, strict=True))], "scan int, x int, px int, py int, value double")


def ray_signals(images: DataFrame, cx: int, cy: int) -> DataFrame:
    """(origin, ray, x, radius, value): the values that `signal.last_drop` reads after smoothing."""
    return over_images(images, lambda a: [(i, k, int(r), float(v)) for i, radii, values in rays(a, cx, cy) for k, (r, v) in enumerate(zip(radii, values, strict=True))], "ray int, x int, radius int, value double")


def text_components(a: np.ndarray) -> list[tuple[int, int, int, int, int, int, float]]:
    """(idx, x, y, w, h, area, middle) of the dark marks of a strip, from left to right."""
    hat = blackhat(a, max(17, a.shape[1] // 60), max(5, a.shape[0] // 5))
    boxes = []
    for part in labelled(hat > otsu(hat)):
        (y0, x0), (y1, x1) = part.min(0), part.max(0) + 1
        boxes.append((int(x0), int(y0), int(x1 - x0), int(y1 - y0), len(part), float(y0 + (y1 - y0) * 0.5)))
    return [(i, *b) for i, b in enumerate(sorted(boxes))]


def component_rows(images: DataFrame) -> DataFrame:
    """Components of each strip as rows for `signal.runs`."""
    return over_images(images, text_components, "idx int, x int, y int, w int, h int, area int, cy double")


def best_span(energy: np.ndarray, least: int, most: int) -> tuple[int, int]:
    """`signal.best_range` for one signal in memory."""
    sums = np.concatenate([[0.0], np.cumsum(energy)])
    least = max(1, least)
    best = (-1.0, 0, len(energy))
    for n in range(least, min(max(least, most), len(energy)) + 1):
        got = sums[n:] - sums[:-n]
        i = int(got.argmax())
        if got[i] > best[0] or (got[i] == best[0] and (i, i + n) < best[1:]):
            best = (float(got[i]), i, i + n)
    return best[1], best[2]


def text_band(a: np.ndarray, dot: bool) -> tuple[int, int, int, int]:
    """(x, y, w, h) of the band of a crop where most of the dark strokes lie."""
    rows, cols = a.shape
    even = clahe(a)
    focus = even if dot else even[: max(1, int(np.floor(rows * 0.68 + 0.5)))]
    hat = blackhat(focus, *((15, 5) if dot else (31, 9)))
    binary = close(np.where(hat > otsu(hat), 255, 0).astype(np.uint8), 9 if dot else 21, 3)
    by_row, by_col = energies(binary)
    n, m = binary.shape
    least = max(12, n // 8) if dot else max(22, n // 4)
    top, bottom = best_span(by_row, least, max(least + 8, n // 2) if dot else max(least + 12, n * 3 // 5))
    x0, x1, y0, y1 = 0, cols, max(0, top - (6 if dot else 12)), min(n, bottom + (6 if dot else 10))
    if dot:
        wide = max(50, m // 6)
        a0, a1 = best_span(by_col, wide, max(wide + 40, m * 3 // 4))
        a0, a1 = max(0, a0 - 12), min(cols, a1 + 12)
        x0, x1 = (a0, a1) if a1 - a0 >= wide else (0, cols)
    else:
        band = binary[max(0, top - 4) : max(max(0, top - 4) + 1, min(n, bottom + 4))]
        wide = max(140, m // 2)
        a0, a1 = best_span(energies(band)[1], wide, cols)
        if a1 - a0 >= wide:
            x0, x1 = max(0, a0 - 18), min(cols, a1 + 18)
        y1 = min(rows, max(y1, int(np.floor(rows * 0.58 + 0.5))))
    if y1 - y0 < least:
        y0, y1 = 0, rows if dot else min(rows, max(1, int(np.floor(rows * 0.60 + 0.5))))
    return x0, y0, max(1, x1 - x0), max(1, y1 - y0)


def combined_wheel(a: np.ndarray) -> tuple[bool, float, float, float, float]:
    """(found, cx, cy, inner, outer): the wheel whose inner circle comes from the border scans and whose outer radius from rays."""
    points = []
    for _, places, values in borders(a):
        smooth = np.convolve(np.pad(np.array(values, float), 7), np.ones(15), "valid") / np.convolve(np.pad(np.ones(len(values)), 7), np.ones(15), "valid")
        dark = np.flatnonzero((smooth < 50) & (np.maximum.accumulate(smooth) > 80))
        if len(dark):
            points.append(places[dark[0]])
    if len(points) < 3:
        return False, 0.0, 0.0, 0.0, 0.0
    p = np.array(points, float)
    d, e, f = np.linalg.lstsq(np.c_[p, np.ones(len(p))], (p**2).sum(1), rcond=None)[0]
    cx, cy = d / 2, e / 2
    inner = float(np.sqrt(max(0.0, f + cx * cx + cy * cy)))
    side, outer = min(a.shape), []
    for _, radii, values in rays(a, int(np.rint(cx)), int(np.rint(cy))):
        smooth = np.convolve(np.pad(np.array(values, float), 3), np.ones(7), "valid") / np.convolve(np.pad(np.ones(len(values)), 3), np.ones(7), "valid")
        drops = np.flatnonzero((np.diff(smooth) < -10) & (np.array(radii[:-1]) > 100))
        if len(drops) and drops[-1] > 0:
            outer.append(radii[drops[-1]])
    radius = float(sorted(outer)[len(outer) // 2]) if outer else 0.0
    found = 0.18 * side < inner < 0.48 * side and radius > inner + 40
    return (True, float(cx), float(cy), inner, radius) if found else (False, 0.0, 0.0, 0.0, 0.0)


def wheels(images: DataFrame) -> DataFrame:
    """The combined wheel hypothesis per image; other hypotheses join it as columns for `select.wheel_choice`."""
    return over_images(images, lambda a: [combined_wheel(a)], "found boolean, center_x double, center_y double, inner_radius double, outer_radius double")


def crop(a: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The part of a raster inside a box; a dark placeholder of 140 x 520 where there is none."""
    part = a[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)]
    return part if part.size else np.full((140, 520), 20, np.uint8)


def pgm(a: np.ndarray) -> bytes:
    """A gray raster as a portable graymap, which needs no encoder."""
    return b"P5\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + np.ascontiguousarray(a).tobytes()
