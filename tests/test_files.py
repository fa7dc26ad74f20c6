"""Readers, writers, pixel kernels and the stream."""

import json
import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from rimlight.functions import pixels
from rimlight.operators import providers, signal
from rimlight.plans import results
from rimlight.sources import files, sinks
from rimlight.streaming import votes


def png(path, a):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + r.tobytes() for r in a)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))


def test_expected_and_reports(spark, tmp_path):
    path = tmp_path / "expected.csv"
    path.write_text('filename,a,b,c,d,e,f,g\na.png,1/2,,,x,y,easy,old\n\nshort,row\nb.png,"205/55 R16, x",1422,DOT7X9M1422,"say ""hi""",m,hard,n,more\na.png,225/40 R18,3523,DOT1ABC3523,M,P,medium,new\n')
    rows = {r.filename: r for r in files.expected(spark, str(path)).collect()}
    assert set(rows) == {"a.png", "b.png"} and rows["a.png"].notes == "new" and rows["a.png"].expected_dot4 == "3523"
    assert rows["b.png"].expected_size == "205/55 R16, x" and rows["b.png"].brand == 'say "hi"'
    answer = {"inputPath": "/x/a.png", "tyreSizeFound": True, "tyreSize": {"normalized": "225/40 R18", "confidence": 0.9, "roiQuality": 0.8}, "dotFound": False, "timings": {"totalMs": 12.5}, "stepTimings": [{"name": "wheel_total_ms", "ms": 2.0}], "notes": ["n1", "n2"]}
    (tmp_path / "answers.jsonl").write_text(json.dumps(answer) + "\n" + json.dumps({"error": "boom"}) + "\nnot json\n")
    found = results.report(spark, str(path), str(tmp_path / "answers.jsonl"))
    row = found.collect()[0]
    assert (row.size_match, row.dot4_match, row.reason) == (True, False, "image_quality_issue")
    sinks.write_reports(found, str(tmp_path / "out"))
    text = {n: "".join(p.read_text() for p in (tmp_path / f"out/{n}.csv").glob("part-*")) for n in ("summary", "per_image", "errors")}
    assert text["summary"].startswith("metric,value\ntotalImages,1\n") and "sizeExactMatchCount,1\n" in text["summary"] and "avgTotalMs,12.5000\n" in text["summary"]
    assert text["per_image"].splitlines()[1] == "a.png,225/40 R18,225/40 R18,3523,,DOT1ABC3523,,true,0.9000,false,0.0000,12.5000,true,false,false,image_quality_issue,M,P,medium,new"
    assert text["errors"].splitlines() == ["filename,expected_size,predicted_size,expected_dot4,predicted_dot4,expected_dot_full,predicted_dot_full,size_confidence,dot_confidence,total_ms,suspected_reason", "a.png,225/40 R18,225/40 R18,3523,,DOT1ABC3523,,0.9000,0.0000,12.5000,image_quality_issue"]
    more = tmp_path / "parts"
    more.mkdir()
    for k in range(3):  # each file has a line of names, and the last row of a file name counts
        (more / f"{k}.csv").write_text("filename,a,b,c,d,e,f,g\n" + f"z.png,{k},,,,,,\n" + f"{k}.png,{k},,,,,,\n")
    assert {r.filename: r.expected_size for r in files.expected(spark, str(more)).collect()} == {"z.png": "2", "0.png": "0", "1.png": "1", "2.png": "2"}
    answers = files.payloads(spark.read.text(str(tmp_path / "answers.jsonl"))).withColumns({"dataset": F.lit("d"), "image_path": F.lit("p")})
    flat = files.program_rows(answers).orderBy("status", "error").collect()
    assert [r.status for r in flat] == ["error", "error", "ok"] and flat[2].wheel_total_ms == 2.0 and flat[2].notes == "n1 | n2" and flat[0].size_raw is None


def test_annotations_suggestions_coco(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text(json.dumps({"items": [{"image": "/A/x.png", "sizeText": "s"}, {"image": ""}, {"image": "/a/X.png", "dotVisible": False, "sizeCropBottomPercent": 50}]}))
    rows = files.annotations(spark, str(path))
    (one,) = rows.collect()
    assert (one.image, one.sizeText, one.sizeVisible, one.dotVisible, one.sizeCropTopPercent, one.sizeCropBottomPercent) == ("/a/x.png", "", True, False, 0, 50)
    sinks.write_annotations(rows, str(tmp_path / "saved"))
    assert files.annotations(spark, str(tmp_path / "saved")).collect() == [one]
    (tmp_path / "s.csv").write_text('image,size_base_guess,notes\n/A/1.png,x,"a, b"\n,y,\n/a/1.PNG,z,\n')
    (s,) = files.suggestions(spark, str(tmp_path / "s.csv")).collect()
    assert (s.key, s.size_base_guess, s.dot4_guess) == ("/a/1.png", "z", "")
    (tmp_path / "c.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a.png", "width": 100, "height": 50}, {"id": 2, "file_name": "b.png", "width": 10, "height": 10}], "categories": [{"id": 5, "name": "Size"}, {"id": 9, "name": "None"}], "annotations": [{"image_id": 1, "category_id": 5, "bbox": [10, 10, 20, 10]}]}))
    from rimlight.operators import etl

    images, found, used = files.coco(spark, str(tmp_path / "c.json"))
    lines = {r.file_name: r.lines for r in etl.label_lines(etl.yolo_labels(images, found, etl.category_index(used, "label"))).collect()}
    assert lines == {"a.png": "0 0.200000 0.300000 0.200000 0.200000", "b.png": ""}
    assert sinks.dataset_yaml(["a"]).endswith("names: ['a']\n")
    found_ = etl.yolo_labels(images, found, etl.category_index(used, "label")).withColumn("split", F.when(F.col("image") == 1, "train").otherwise("val"))
    assert sinks.write_labels(found_, str(tmp_path / "set"), ["Size"]) == {"images_total": 2, "annotations_total": 1, "class_names": ["Size"], "splits": {"train": 1, "val": 1}}
    assert (tmp_path / "set/labels/train/a.txt").read_text() == "0 0.200000 0.300000 0.200000 0.200000\n" and (tmp_path / "set/labels/val/b.txt").read_text() == ""
    assert json.loads((tmp_path / "set/summary.json").read_text())["splits"]["val"] == 1 and sorted(p.name for p in (tmp_path / "set").iterdir()) == ["dataset.yaml", "labels", "summary.json"]
    sinks.place_file(str(path), str(tmp_path / "x/y.json"))
    assert (tmp_path / "x/y.json").read_text() == path.read_text()


def test_numbers_as_c_prints_them(spark):
    values = [2.00005, 0.5, 1.00015, 0.00005, -1.23456, 123456.78905, 1 / 3, 0.0, 0.03125, 0.09375, 99.99995, -0.00001]
    got = [r.n for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").orderBy("i").select(sinks.number(F.col("v")).alias("n")).collect()]
    assert got == [f"{v:.4f}" for v in values]


def disc(h=160, w=200, cx=100, cy=80, r=60):
    y, x = np.mgrid[:h, :w]
    return np.where((x - cx) ** 2 + (y - cy) ** 2 < r * r, 30, 220).astype(np.uint8)


def test_pixels(spark, tmp_path):
    folder = tmp_path / "images"
    folder.mkdir()
    a = disc()
    png(folder / "a.png", np.repeat(a[:, :, None], 3, 2))
    (folder / "bad.jpg").write_bytes(b"no image")
    (folder / "note.txt").write_text("x")
    rows = files.images(spark, str(folder))
    assert [(r.height, r.note != "") for r in rows.select("origin", "height", "note").collect()] == [(160, False), (-1, True)]
    assert files.dataset_folder(spark, str(tmp_path)).endswith("/images") and files.image_files(spark, str(folder)).count() == 2
    score, sharp, contrast = pixels.quality(a)
    (q,) = pixels.qualities(rows).collect()
    assert abs(q.score - score) < 0.02 and 0 < score <= 1 and sharp > 0 and contrast > 64
    assert pixels.otsu(a) in range(30, 220) and (pixels.close(a, 3, 3) >= a).all() and (pixels.opened(a, 3, 3) <= a).all()
    mask, found = pixels.foreground(a)
    assert found and abs((mask > 0).mean() - (a < 100).mean()) < 0.06
    strip = pixels.unwrap(a, 100, 80, 30, 75)
    assert strip.shape[1] == 1440 and strip[-1].mean() < 60 and strip[0].mean() > 180
    assert pixels.sector(strip, 350, 10).shape[1] == 80
    assert [n for n, _ in pixels.variants(a[:50, :90], True)] == ["gray", "clahe", "blackhat", "otsu", "adaptive", "adaptive_inv", "blackhat_inv"]
    assert len(pixels.labelled(np.array([[1, 0, 1], [1, 0, 1], [0, 0, 0], [1, 1, 1]], bool))) == 3
    assert pixels.to_megapixels(a, 0.008).size in range(7800, 8200)
    signals = pixels.border_signals(rows).withColumn("v", signal.moving_average(F.col("value"), ["scan"], "x", 7))
    points = signal.border(signals, ["scan"], "x", "v").join(signals, "scan").where("x = border").select(F.lit(1).alias("k"), F.col("px").cast("double").alias("x"), F.col("py").cast("double").alias("y"))
    (c,) = signal.circle_fit(points, ["k"]).collect()
    assert abs(c.cx - 100) < 3 and abs(c.cy - 80) < 3 and abs(c.radius - 53) < 2  # smoothing over 15 values finds the edge 7 inside
    big = np.full((500, 500), 220, np.uint8)
    y, x = np.mgrid[:500, :500]
    r = np.hypot(x - 250, y - 250)
    big[r < 220] = 160
    big[r < 130] = 20
    assert np.allclose(pixels.combined_wheel(np.where(r < 220, big, 60))[1:4], (250, 250, 130), atol=12)
    rng = np.random.default_rng(0)
    for _ in range(40):
        e = rng.integers(0, 5, rng.integers(1, 12)).astype(float)
        spans = [(-e[i:j].sum(), i, j) for i in range(len(e)) for j in range(i + 2, min(len(e), i + 4) + 1)]
        assert pixels.best_span(e, 2, 4) == (min(spans)[1:] if spans else (0, len(e)))
    text = np.full((80, 300), 200, np.uint8)
    for k in range(6):
        text[30:50, 60 + 30 * k : 68 + 30 * k] = 30
    assert [c[1:6] for c in pixels.text_components(text)] == [(60 + 30 * k, 30, 8, 20, 160) for k in range(6)]
    x0, y0, w, h = pixels.text_band(text, True)
    assert y0 <= 30 and y0 + h >= 48 and x0 <= 62 and x0 + w >= 216
    assert pixels.crop(text, 290, 70, 50, 50).shape == (10, 10) and pixels.crop(text, 400, 0, 5, 5).shape == (140, 520) and pixels.pgm(text).startswith(b"P5\n300 80\n255\n")
    read = providers.FunctionProvider(lambda: lambda data, h, w: (f"{w}x{h}", 0.9), stop=0.5).read(pixels.all_variants(rows), "size").collect()
    assert [(r.seq, r.conf) for r in read] == [(0, 0.9)]


def test_answers_as_text(spark):
    df = spark.sql("""select 'a"b' as name, 0.5D as score, cast(null as double) as none, array(named_struct('label', 'Size', 'confidence', 1/3D, 'box', named_struct('x', 1, 'y', 2, 'w', 3, 'h', 4))) as found, named_struct('ms', 2.00005D) as timings, true as ok""")
    text = sinks.result_json(df).first().value
    assert text == r'{"name":"a\"b","score":0.5000,"none":null,"found":[{"label":"Size","confidence":0.3333,"box":"1,2,3,4"}],"timings":{"ms":2.0000},"ok":true}'
    assert json.loads(sinks.result_json(df, pretty=True).first().value)["timings"] == {"ms": 2.0}


def reader():
    return lambda data, h, w: ("225/40 R18", 0.9)


def test_image_modes(spark, tmp_path):
    from rimlight import cli

    folder = tmp_path / "root/images"
    folder.mkdir(parents=True)
    big = np.full((500, 500), 60, np.uint8)
    y, x = np.mgrid[:500, :500]
    r = np.hypot(x - 250, y - 250)
    big[r < 220] = 160
    big[r < 130] = 20
    for name, a in (("a.png", big), ("b.png", disc())):
        png(folder / name, np.repeat(a[:, :, None], 3, 2))
    (tmp_path / "root/expected.csv").write_text("filename,a,b,c,d,e,f,g\na.png,225/40 R18,,,x,y,easy,n\n")

    def answers(out):
        return [json.loads(x) for p in sorted((out / "answers").glob("part-*")) for x in p.read_text().splitlines()]

    assert cli.main(["--wheel-image", str(folder / "a.png"), "--output", str(tmp_path / "w")]) == 0
    (one,) = answers(tmp_path / "w")
    assert one["wheelFound"] and abs(one["wheelInnerRadius"] - 130) < 12 and (tmp_path / "w" / one["unwrappedBandPath"]).read_bytes().startswith(b"P5")
    assert cli.main(["--unwrap-sector", str(folder / "a.png"), "--angles", "350,10", "--branch", "dot", "--output", str(tmp_path / "s")]) == 0
    (one,) = answers(tmp_path / "s")
    assert one["branch"] == "dot" and one["startAngleDeg"] == 350 and (tmp_path / "s/a/dot_sector.pgm").exists()
    assert cli.main(["--ocr-roi", str(folder / "a.png"), "--roi", "10,10,100,50", "--recognizer", "tests.test_files:reader", "--output", str(tmp_path / "r")]) == 0
    (one,) = answers(tmp_path / "r")
    assert (one["roi"], one["normalizedText"], one["found"]) == ("10,10,100,50", "225/40 R18", True) and (tmp_path / "r" / one["cropPath"]).exists()
    back = files.rois(spark.createDataFrame([(json.dumps(one),)], "value string")).first()
    assert back.status == "ok" and tuple(back.box) == (10, 10, 100, 50)
    assert cli.main(["--dir", str(folder), "--skip-ocr", "--output", str(tmp_path / "d")]) == 0
    assert [(x["frameId"], x["wheelFound"], x["tyreSizeFound"]) for x in sorted(answers(tmp_path / "d"), key=lambda x: x["frameId"])] == [("a", True, False), ("b", False, False)]
    assert cli.main(["--dataset", str(tmp_path / "root"), "--recognizer", "tests.test_files:reader", "--output", str(tmp_path / "e")]) == 0
    assert "sizeExactMatchCount,1\n" in "".join(p.read_text() for p in (tmp_path / "e/summary.csv").glob("part-*"))
    assert cli.main(["--wheel-debug-dir", str(folder), "--output", str(tmp_path / "x")]) == 0
    assert (tmp_path / "x/a/wheel_report.txt").read_text().startswith("found: true\ncenter_x: ")
    strip = pixels.unwrap_inside(big, 250, 250, 130, 220)
    assert strip.shape == (220, int(2 * np.pi * 218)) and abs(int(strip[110].mean()) - 160) < 3


def test_training_export(spark, tmp_path):
    rows = files.annotations(spark, str(_annotated(tmp_path))).withColumn("annotation_image", F.col("image"))
    existing = spark.createDataFrame([("/p/s.png", b"S"), ("/p/none.png", b"N")], "path string, content binary")
    sinks.write_training_export(rows, existing, str(tmp_path / "out"))
    assert (tmp_path / "out/size_crops/x_size.png").read_bytes() == b"S" and not (tmp_path / "out/dot_crops").exists()
    assert len("".join(p.read_text() for p in (tmp_path / "out/annotations.csv").glob("part-*")).splitlines()) == 2


def _annotated(tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"items": [{"image": "/A/x.png", "sizePreviewPath": "/p/s.png", "dotPreviewPath": "/p/gone.png"}]}))
    return path


def test_reports_of_candidates_and_detections(spark, tmp_path):
    from rimlight.plans import registry

    sinks.write_candidates(registry.QUERIES["candidates_report"](spark, "/root/testdata/sf0.001").drop("image", "seq").limit(20), str(tmp_path / "c"))
    lines = "".join(p.read_text() for p in (tmp_path / "c").glob("part-*")).splitlines()
    assert lines[0] == "branch,roi_id,variant,psm,width,height,elapsed_ms,ocr_conf,regex_valid,domain_score,final_score,status,text,normalized" and len(lines) == 21
    assert lines[1].split(",")[1].startswith('"roi_') and len(lines[1].split(",")[6].split(".")[1]) == 4
    assert files.ocr_candidates(spark, str(tmp_path / "c")).where("status is null").count() == 0
    summary, every = registry._files(spark, "/root/testdata/sf0.001")
    sinks.write_detections(summary.limit(5), every.limit(5), str(tmp_path / "det"))
    head = "".join(p.read_text() for p in (tmp_path / "det/detections_all.csv").glob("part-*")).splitlines()
    assert head[0] == "dataset,image_path,label,confidence,box,crop_box,crop_path" and len(head) == 6


def test_stream_votes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [("c", f"2026-01-01T00:00:0{i}Z", text, 0.9) for i, text in enumerate(["225/40 R18", "225/40 R18", "205/55 R16", "junk"])] + [("c", "2026-01-01T00:05:00Z", "205/55 R16", 0.9), ("c", "2026-01-01T00:10:00Z", "205/55 R16", 0.9)]
    for i, x in enumerate(lines):
        (tmp_path / f"in/{i}.json").write_text(json.dumps(dict(zip(["camera", "ts", "text", "conf"], x, strict=True))))
    query = votes.run(votes.readings(spark, str(tmp_path / "in"), 3), str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).orderBy("start").collect()
    assert (found[0].size, found[0].frames) == ("225/40 R18", 2)
