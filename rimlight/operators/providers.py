"""Recognizers and detectors as exchangeable sources of rows. None ships here: their outputs are input tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimlight.functions import geometry as g
from rimlight.operators import boxes

CANDIDATES = "image string, field string, seq int, variant string, text string, conf double"


@dataclass(frozen=True)
class TableProvider:
    """Readings that exist already, as a table in the candidates' columns."""

    table: DataFrame

    def read(self, images: DataFrame) -> DataFrame:
        """Only the readings of these images."""
        return self.table.join(images.select(F.col("origin").alias("image")).distinct(), "image", "left_semi")


@dataclass(frozen=True)
class FunctionProvider:
    """A recognizer that is made once in each worker, then called on one raster after another."""

    make: Callable[[], Callable[[bytes, int, int], tuple[str, float]]]
    stop: float = 2.0

    def read(self, variants: DataFrame, field: str) -> DataFrame:
        """Readings of `pixels.all_variants` rows; reading an image ends once the confidence reaches `stop`."""
        make, stop = self.make, self.stop

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            recognize, done = make(), set()
            for pdf in batches:
                rows = []
                for r in pdf.itertuples(index=False):
                    if r.origin not in done:
                        text, conf = recognize(r.data, r.height, r.width)
                        rows.append((r.origin, field, r.seq, r.variant, text, conf))
                        if conf >= stop:
                            done.add(r.origin)
                yield pd.DataFrame(rows, columns=[c.split()[0] for c in CANDIDATES.split(", ")])

        ordered = variants.repartition("origin").sortWithinPartitions("origin", "seq")
        return ordered.select("origin", "seq", "variant", "data", "height", "width").mapInPandas(run, CANDIDATES)


def decoded(raw: DataFrame, width: Column, height: Column, labels: list[str], threshold: float = 0.20, least: int = 12, overlap: float = 0.45) -> DataFrame:
    """Detections from raw rows (image, idx, cx, cy, w, h, scores) of a 640 x 640 detector: class, threshold, mapping back, suppression."""
    rows = raw.withColumn("p", g.class_argmax(F.col("scores"))).where((F.col("p.cls") >= 0) & (F.col("p.score") >= threshold))
    rows = rows.withColumn("box", g.from_letterbox(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), g.letterbox(width, height), width, height))
    rows = rows.where((F.col("box.w") >= least) & (F.col("box.h") >= least)).select("image", "idx", F.col("p.cls").alias("cls"), F.col("p.score").alias("conf"), "box")
    kept = boxes.greedy(rows, ["image", "cls"], overlap, score="conf")
    names = F.array(*(F.lit(x) for x in labels))
    return kept.select("image", "idx", F.element_at(names, F.col("cls") + 1).alias("label"), "conf", "box")
