"""Points from delimited text or any DataFrame, and labelled points back to text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(1 << 31), (1 << 31) - 1


def to_int(value: Column, scale: float = 1.0, rounding: str = "half_toward_zero") -> Column:
    """``scale * value`` as an int: half is added, then cut toward zero (``half_up``: floored); saturates."""
    x = F.lit(0.5) + F.lit(float(scale)) * value.cast("double")
    x = F.floor(x).cast("double") if rounding == "half_up" else x
    return F.greatest(F.least(x, F.lit(float(INT_MAX))), F.lit(float(INT_MIN))).cast("int")


def tokens(line: Column) -> Column:
    """Non-empty fields between tabs, spaces and commas."""
    return F.filter(F.split(line, "[\\t ,]+"), lambda t: t != "")


def parse_lines(lines: DataFrame, dims: int, scale: float = 1.0, rounding: str = "half_toward_zero", line_col: str = "value") -> DataFrame:
    """Columns ``x0 .. x{dims-1}``. Blank or ragged lines, and fields that are no integers, raise an error."""
    t = tokens(F.col(line_col))
    fault = F.raise_error(F.concat(F.lit(f"expected {dims} integers in line: "), F.coalesce(F.col(line_col), F.lit("null"))))
    rows = lines.select(F.when(F.size(t) == dims, t).otherwise(fault.cast("array<string>")).alias("t"))
    return rows.select(*[to_int(F.col("t")[i].cast("int"), scale, rounding).alias(f"x{i}") for i in range(dims)])


def read_text(spark: SparkSession, path: str, scale: float = 1.0, rounding: str = "half_toward_zero") -> DataFrame:
    """Points of a text file, folder or glob; the first line tells how many dimensions there are."""
    lines = spark.read.text(path)
    first = lines.select(F.size(tokens(F.col("value"))).alias("n")).first()
    if first is None or not first["n"]:
        raise ValueError(f"no points in {path}")
    return parse_lines(lines, first["n"], scale, rounding)


def from_dataframe(df: DataFrame, feature_cols: Sequence[str], scale: float | None = None) -> DataFrame:
    """``df`` with its features as int columns ``x0 ..`` in front; values are cast unless scaled."""
    cols = [(to_int(F.col(c), scale) if scale is not None else F.col(c).cast("int")).alias(f"x{i}") for i, c in enumerate(feature_cols)]
    return df.select(*cols, *[c for c in df.columns if c not in {f"x{i}" for i in range(len(cols))}])


def label_lines(labelled: DataFrame, cols: Sequence[str], label: str = "label") -> DataFrame:
    """One line per point: its coordinates and its label, separated by spaces."""
    return labelled.select(label_line(cols, label).alias("value"))


def label_line(cols: Sequence[str], label: str = "label") -> Column:
    return F.concat_ws(" ", *[F.col(c).cast("string") for c in cols], F.col(label).cast("string"))


def write_labels(labelled: DataFrame, cols: Sequence[str], path: str, label: str = "label") -> None:
    """Text files of ``label_lines``; fails if the folder exists."""
    label_lines(labelled, cols, label).write.mode("errorifexists").text(path)
