"""One mode a run."""

import pytest

from rimlight import cli


def test_modes():
    p = cli.parser()
    assert p.parse_args(["--query", "nms", "--data", "/d"]).query == "nms"
    for bad in ([], ["--query", "nms", "--annotations", "x"], ["--query", "no such"]):
        with pytest.raises(SystemExit):
            p.parse_args(bad)


def test_query_to_csv(spark, tmp_path):
    assert cli.main(["--query", "suspected_reason", "--data", "/root/testdata/sf0.001", "--output", str(tmp_path / "out")]) == 0
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")).startswith("reason,n\n")
