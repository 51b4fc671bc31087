"""``python -m orogen PATH [SCALE]``: cluster a text file of points, write ``PATH.labels``."""

import sys

from pyspark.sql import SparkSession

from orogen.plans.clustering import fit
from orogen.sources.points import read_text


def main(args: list[str]) -> int:
    if not args:
        print("File name missing")
        return 1
    spark = SparkSession.builder.appName("orogen").getOrCreate()
    points = read_text(spark, args[0], float(args[1]) if len(args) > 1 else 1.0)
    fit(points, points.columns, labels=f"{args[0]}.labels", report=True)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
