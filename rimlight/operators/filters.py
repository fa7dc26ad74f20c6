"""Which components, candidates, regions and files count, and which of several values is shown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rimlight.functions import text as t


def component(field: str, w: Column, h: Column, area: Column, cols: Column, rows: Column) -> Column:
    """Whether a component of a strip may be a character of the field's text."""
    low, high, wide = (0.16, 0.78, 0.035) if field == "size" else (0.06, 0.70, 0.12)
    return h.between(rows * low, rows * high) & w.between(F.lit(4.0), cols * wide) & (area >= w * h * 0.15)


def candidate(field: str, w: Column, h: Column, count: Column, cols: Column, structure: Column) -> Column:
    """Whether a run of components may be a line of the field's text."""
    shape = w.cast("double") / F.greatest(F.lit(1), h)
    if field == "size":
        return shape.between(2.2, 12.0) & count.between(4, 14) & (w >= 160) & (w <= F.greatest(F.lit(320), F.floor(cols / 3))) & (structure >= 0.46)
    return shape.between(1.4, 10.0) & count.between(3, 16) & (w >= 110) & (w <= F.greatest(F.lit(240), F.floor(cols / 4)))


def run_box(box: Column, avg_height: Column) -> Column:
    """A run's box with room around it, before clamping."""

    def part(x: Column, share: float) -> Column:
        return F.floor(x * share).cast("int")

    w, h = box["w"], box["h"]
    x, y = box["x"] - F.greatest(F.lit(12), F.floor(w / 12).cast("int")), box["y"] - F.greatest(F.lit(8), part(avg_height, 0.25))
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), (w + F.greatest(F.lit(24), F.floor(w / 6).cast("int"))).cast("int").alias("w"), (h + F.greatest(F.lit(18), part(avg_height, 0.45))).cast("int").alias("h"))


def proposal(w: Column, h: Column, image_area: Column) -> Column:
    """Whether a contour's box may be a region of text."""
    area, shape = w.cast("double") * h, w.cast("double") / F.greatest(F.lit(1), h)
    return area.between(image_area * 0.0004, image_area * 0.28) & (w >= 40) & (h >= 12) & shape.between(1.6, 18.0)


def readable(w: Column, h: Column) -> Column:
    """Whether a region is worth reading."""
    return (w >= 48) & (h >= 16) & (w.cast("double") / F.greatest(F.lit(1), h)).between(1.2, 80.0)


def shown(name: Column, text: Column) -> Column:
    """Whether a name holds the filter's text, in any case; a blank filter shows all."""
    want = F.trim(t.blank(text))
    return (want == "") | F.contains(F.lower(t.blank(name)), F.lower(want))


def original(path: Column) -> Column:
    """Whether a file isn't marked as a copy by (1)."""
    return ~F.contains(t.file_name(path), F.lit("(1)"))


def ladder(*values: Column) -> Column:
    """The first value that isn't blank."""
    return F.coalesce(*(F.nullif(t.blank(v), F.lit("")) for v in values), F.lit(""))


def first_existing(paths: Sequence[Column], images: Column, words: Sequence[str], existing: Column) -> Column:
    """The first path that exists, else that of the first image (struct label, path) whose label or path holds one of the words.

    existing: an array of the paths that are there.
    """

    def there(p: Column) -> Column:
        return F.coalesce((p != "") & F.array_contains(existing, p), F.lit(False))

    def named(i: Column) -> Column:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(i["label"]), F.lit(w)) | F.contains(F.lower(i["path"]), F.lit(w))
        return hit & there(i["path"])

    found = F.try_element_at(F.filter(images, named), F.lit(1))["path"]
    return F.coalesce(*(F.when(there(p), p) for p in paths), found, F.lit(""))


def wheel(override: Column, by_hand: Column, detected: Column) -> Column:
    """The wheel that counts: the one set by hand, if any."""
    return F.when(override, by_hand).otherwise(detected)


def edge_windows(cols: Column, rows: Column, overlap: Column) -> Column:
    """The four fixed windows near the seam of a strip that repeats `overlap` columns, as array of struct(x, y, w, h)."""

    def clamp(x: Column, lo: Column, hi: Column) -> Column:
        return F.least(F.greatest(x, lo), hi)

    h = clamp(F.floor(rows * 0.34).cast("int"), F.lit(48), F.greatest(F.lit(48), F.floor(rows / 2).cast("int")))
    w = clamp(F.floor(cols * 0.16).cast("int"), F.lit(260), F.greatest(F.lit(260), F.floor(cols / 4).cast("int")))
    margin = clamp(F.floor(cols * 0.03).cast("int"), F.lit(24), F.lit(160))
    half = F.floor(w / 2).cast("int")
    xs = (overlap + margin, overlap + margin + half, overlap + cols - margin - w, overlap + cols - margin - w - half)
    return F.array(*(F.struct(x.cast("int").alias("x"), F.lit(0).alias("y"), w.alias("w"), h.alias("h")) for x in xs))


def unseamed(x: Column, w: Column, cols: Column, overlap: Column) -> Column:
    """struct(x, w): a window of the repeated strip on the strip itself."""
    return F.struct(F.pmod(x - overlap + cols, cols).cast("int").alias("x"), F.least(w, cols).cast("int").alias("w"))
