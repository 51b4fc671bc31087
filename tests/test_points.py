import pytest

from orogen.sources import points


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_separators_and_empty_fields(spark):
    assert rows(points.parse_lines(lines(spark, "1, 2\t3", "  4,,5 6"), 3)) == [(1, 2, 3), (4, 5, 6)]


def test_rounding_toward_zero_and_half_up(spark):
    df = lines(spark, "-3", "-1", "0", "2")
    assert rows(points.parse_lines(df, 1)) == [(-2,), (0,), (0,), (2,)]
    assert rows(points.parse_lines(df, 1, rounding="half_up")) == [(-3,), (-1,), (0,), (2,)]


def test_scale(spark):
    assert rows(points.parse_lines(lines(spark, "1", "2", "3"), 1, 0.5)) == [(1,), (1,), (2,)]


def test_saturation(spark):
    assert rows(points.parse_lines(lines(spark, "2000000000", "-2000000000"), 1, 10.0)) == [(-(1 << 31),), ((1 << 31) - 1,)]


@pytest.mark.parametrize("bad", ["1 2", "", "1 2 x"])
def test_ragged_blank_and_foreign_lines_raise(spark, bad):
    with pytest.raises(Exception):
        points.parse_lines(lines(spark, "1 2 3", bad), 3).collect()


def test_file_roundtrip(spark, tmp_path):
    (tmp_path / "in.txt").write_text("1 2\n3 4\n")
    df = points.read_text(spark, str(tmp_path / "in.txt"))
    points.write_labels(df.selectExpr("*", "7 as label"), ["x0", "x1"], str(tmp_path / "out"))
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1 2 7", "3 4 7"]
    with pytest.raises(Exception):
        points.write_labels(df.selectExpr("*", "7 as label"), ["x0", "x1"], str(tmp_path / "out"))


def test_empty_file_raises(spark, tmp_path):
    (tmp_path / "in.txt").write_text("")
    with pytest.raises(ValueError):
        points.read_text(spark, str(tmp_path / "in.txt"))
