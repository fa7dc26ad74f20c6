"""Parsers on hand cases and against small models."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rimlight.functions import text as t

SIZES = [
    ("225/40 R18", "225/40 R18", 1.0), ("2254018", "225/40 R18", 0.88), ("205\\55 R16 V", "205/55 R16 V", 0.91), ("225/40ZR18", "", 0.0), ("225/40 R18S", "", 0.0),
    ("225/40 R18 92Y", "225/40 R18", 1.0), ("399/40 R18 225/40 R18", "", 0.0), ("2O5/55 R1S", "205/55 R15", 1.0), ("  225 / 40\tR 18 ", "225/40 R18", 1.0), ("", "", 0.0), (None, "", 0.0), ("1225/40 R18", "", 0.0),
]
DOTS = [
    ("DOT 1ABC 3523", "DOT1ABC3523", True, "3523", 1.0), ("DOT3KLM", "DOT3KLM", False, "", 0.55), ("LOSI", "1051", False, "1051", 0.82), ("3523", "3523", False, "3523", 0.82),
    ("9923", "", False, "", 0.0), ("", "", False, "", 0.0), (None, "", False, "", 0.0), ("dot 12", "", False, "", 0.0), ("3523 x 1", "", False, "", 0.0),
]


def run(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_sizes(spark):
    got = run(spark, [s for s, *_ in SIZES], t.parse_size(F.col("s")).alias("p"))
    assert [(p.normalized, round(p.quality, 6)) for (p,) in got] == [(n, q) for _, n, q in SIZES]
    assert [p.found for (p,) in got] == [n != "" for _, n, _ in SIZES]


def test_dots(spark):
    got = run(spark, [s for s, *_ in DOTS], t.parse_dot(F.col("s")).alias("p"))
    assert [(p.normalized, p.full, p.week_year, round(p.quality, 6)) for (p,) in got] == [tuple(x[1:]) for x in DOTS]


def test_week_year_is_the_end_of_the_last_digits(spark):
    assert run(spark, ["A12345B", "0123 4", "5423", "1422x"], t.parse_dot(F.col("s"))["week_year"]) == [("2345",), ("1234",), ("",), ("1422",)]


def test_loose_extractors(spark):
    got = run(spark, ["225/40 ZR I5 95W", "x 205 55 R16", "1/2", "DOT: AB12 CD 3523 0199", "9912"], t.extract_size(F.col("s")).alias("a"), t.extract_dot(F.col("s")).alias("d"))
    assert got[0][0].base == "225/40 R15" and got[0][0].full == "225/40 R15 95W"
    assert got[1][0].base == "205/55 R16" and got[2][0].full == ""
    assert got[3][1].text == "DOT AB12 CD 3523 0199" and got[3][1].week_year == "3523"
    assert got[4][1].week_year == ""


def test_paths(spark):
    got = run(spark, ["C:\\A\\.\\b\\..\\Image-(12).JPG", "", None, "/x/image(7).png", "/a/../../b"], t.path_key(F.col("s")), t.number_key(F.col("s")), t.is_image(F.col("s")))
    assert got[0] == ("/c:/a/image-(12).jpg", "", True)
    assert got[1][:2] == ("", "") and got[2][:2] == ("", "") and got[3] == ("/x/image(7).png", "7", True) and got[4][0] == "/b"
    assert run(spark, ["C:\\D\\e", "/mnt/c/D/e", "x"], t.to_wsl(F.col("s")), t.from_wsl(F.col("s"))) == [("/mnt/c/D/e", "C:\\D\\e"), ("/mnt/c/D/e", "C:\\D\\e"), ("x", "x")]


CONFUSED = str.maketrans(t.CONFUSED_FROM, t.CONFUSED_TO)


def size_model(s):
    s = re.sub(r"[ \t-\r]+", " ", s.translate(CONFUSED)).strip(" ")
    m = re.search(t.SIZE, s, re.A)
    if not m or not (125 <= int(m[2]) <= 395 and 20 <= int(m[3]) <= 95 and 10 <= int(m[5]) <= 24):
        return ""
    return f"{m[2]}/{m[3]} {m[4] or 'R'}{m[5]}" + (f" {m[6]}" if m[6] else "")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("0123456789/\\RZVSOIL rdotDOT\tß", max_size=24), min_size=40, max_size=60))
def test_size_like_a_model(spark, texts):
    assert [x for (x,) in run(spark, texts, t.parse_size(F.col("s"))["normalized"])] == [size_model(s) for s in texts]
