"""Command line: exactly one mode, as one Spark job each.

Image modes read images, write answers as JSON lines (answers) and rasters below --output. A recognizer is named as
module:function, a maker for `FunctionProvider`; a dataset's answers may also be given as JSON lines (--results).
"""

from __future__ import annotations

import argparse
import importlib
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimlight.plans import registry
from rimlight.sources import files, sinks

MODES = ("image", "ocr-roi", "unwrap-sector", "wheel-image", "dir", "dataset", "wheel-debug-dir", "query", "evaluate", "suggestions", "annotations")


def _numbers(count: int, kind: type):  # noqa: ANN202 - text -> tuple
    def read(x: str) -> tuple:
        parts = x.split(",")
        if len(parts) != count:
            raise argparse.ArgumentTypeError(f"{count} numbers, separated by commas")
        return tuple(kind(p) for p in parts)

    return read


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="rimlight", description=__doc__)
    mode = p.add_mutually_exclusive_group(required=True)
    mode.add_argument("--image", metavar="FILE", help="one image: its wheel and both fields")
    mode.add_argument("--ocr-roi", metavar="FILE", help="one box (--roi) of an image for a field (--branch)")
    mode.add_argument("--unwrap-sector", metavar="FILE", help="the unwrapped band between two angles (--angles)")
    mode.add_argument("--wheel-image", metavar="FILE", help="one image's wheel")
    mode.add_argument("--dir", metavar="FOLDER", help="all images of a folder")
    mode.add_argument("--dataset", metavar="ROOT", help="reports of a dataset: expected.csv and images/ or train/")
    mode.add_argument("--wheel-debug-dir", metavar="FOLDER", help="the wheels of a folder's images as text reports")
    mode.add_argument("--query", choices=sorted(registry.QUERIES), help="run a registered query over the tables in --data")
    mode.add_argument("--evaluate", metavar="EXPECTED.csv", help="reports of results (--results, JSON lines) against ground truth")
    mode.add_argument("--suggestions", metavar="CSV", help="suggestions by image")
    mode.add_argument("--annotations", metavar="JSON", help="annotations with their defaults")
    p.add_argument("--data", default=".")
    p.add_argument("--results")
    p.add_argument("--output")
    p.add_argument("--pretty", action="store_true")
    p.add_argument("--skip-ocr", action="store_true")
    p.add_argument("--recognizer", metavar="MODULE:FUNCTION")
    p.add_argument("--branch", choices=("size", "dot"), default="size")
    p.add_argument("--roi", type=_numbers(4, int), metavar="X,Y,W,H")
    p.add_argument("--angles", type=_numbers(2, float), metavar="START,END")
    p.add_argument("--wheel-override", type=_numbers(4, float), metavar="X,Y,INNER,OUTER")
    return p


def _reader(args: argparse.Namespace):  # noqa: ANN202 - a provider's read, or None
    if args.skip_ocr or not args.recognizer:
        return None
    from rimlight.operators.providers import FunctionProvider

    module, _, name = args.recognizer.partition(":")
    return FunctionProvider(getattr(importlib.import_module(module), name)).read


def _answer(rows: DataFrame, rasters: DataFrame | None, args: argparse.Namespace) -> None:
    folder = args.output or "output"
    if rasters is not None:
        sinks.write_files(rasters, folder)
    sinks.result_json(rows, args.pretty).write.mode("overwrite").text(f"{folder}/answers")


def main(argv: list[str] | None = None) -> int:
    from rimlight.plans import modes, results

    p = parser()
    args = p.parse_args(argv)
    if args.ocr_roi and not args.roi:
        p.error("--ocr-roi needs --roi")
    if args.unwrap_sector and not args.angles:
        p.error("--unwrap-sector needs --angles")
    spark = SparkSession.builder.appName("rimlight").getOrCreate()
    one = args.image or args.ocr_roi or args.unwrap_sector or args.wheel_image or args.dir or args.wheel_debug_dir
    if one:
        images = files.images(spark, one)
        if args.ocr_roi:
            _answer(*modes.regions(images, args.roi, args.branch, _reader(args)), args)
        elif args.unwrap_sector:
            _answer(*modes.sectors(images, *args.angles, args.branch, args.wheel_override), args)
        elif args.wheel_image:
            _answer(*modes.wheels(images), args)
        elif args.wheel_debug_dir:
            answers, rasters = modes.wheels(images)
            sinks.write_files(rasters, args.output or "output")
            names = {"wheelFound": "found", "wheelCenterX": "center_x", "wheelCenterY": "center_y", "wheelInnerRadius": "inner_radius", "wheelOuterRadius": "outer_radius"}
            lines = sinks.wheel_report(answers.withColumnsRenamed(names).withColumn("image", F.col("frameId")))
            text = lines.withColumn("i", F.monotonically_increasing_id()).groupBy("image").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda s: s["value"]), "\n").alias("data"))
            sinks.write_files(text.select(F.concat("image", F.lit("/wheel_report.txt")).alias("path"), F.concat("data", F.lit("\n")).alias("data")), args.output or "output")
        else:
            _answer(modes.analyses(images, _reader(args)), None, args)
        return 0
    if args.dataset:
        answers = spark.read.text(args.results) if args.results else sinks.result_json(modes.analyses(files.images(spark, files.dataset_folder(spark, args.dataset)), _reader(args)))
        sinks.write_reports(results.compared(spark, f"{args.dataset.rstrip('/')}/expected.csv", answers), args.output or "output")
        return 0
    if args.evaluate:
        sinks.write_reports(results.report(spark, args.evaluate, args.results), args.output or ".")
        return 0
    df = registry.QUERIES[args.query](spark, args.data) if args.query else files.suggestions(spark, args.suggestions) if args.suggestions else files.annotations(spark, args.annotations)
    if args.output:
        sinks.write_csv(df, args.output)
    else:
        df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
