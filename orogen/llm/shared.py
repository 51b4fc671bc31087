"""Helpers shared by the corpus operators: durable scratch tables and connected components.

Nothing here keeps state on a machine-local disk of a cluster: scratch tables are
parquet files in the folder the session names in ``spark.checkpoint.dir``, so a lost
executor only costs the tasks it was running. Tables that later ones replace are deleted at
once, the others with ``clear_scratch`` or when the driver ends.
"""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under this application's folder in the shared one, which goes when the driver ends.

    Without ``spark.checkpoint.dir`` a local master gets a folder of its own; on a cluster that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="orogen-")
        spark.conf.set("spark.checkpoint.dir", root)
    own = f"{root.rstrip('/')}/orogen/{spark.sparkContext.applicationId}"
    if own not in _folders:
        _folders.add(own)
        system, path = file_system(spark, own)
        system.deleteOnExit(path)
    made = f"{own}/{name}-{uuid.uuid4().hex}"
    _made.append(made)
    return made


_folders: set[str] = set()
_made: list[str] = []


def file_system(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables from ``materialise`` that nothing will read again."""
    for t in tables:
        system, path = file_system(t.sparkSession, t._scratch)
        system.delete(path, True)


@contextmanager
def only_result(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes the scratch tables made inside but those the block puts into the list."""
    start, kept = len(_made), []
    yield kept
    clear_scratch(spark, start, {t._scratch for t in kept})


def clear_scratch(spark: SparkSession, start: int = 0, keep: set[str] = frozenset()) -> None:
    """Delete scratch tables (from the ``start``-th on); results that read them must have been written."""
    for name in [m for m in _made[start:] if m not in keep]:
        system, path = file_system(spark, name)
        system.delete(path, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = Path(__file__).resolve().parents[1]
    name = Path(tempfile.mkdtemp(prefix="orogen-code-")) / f"{top.name}.zip"
    with zipfile.ZipFile(name, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    context.addPyFile(str(name))
    _shipped.add(context.applicationId)


#: Bytes of an Arrow batch on its way to a Python worker, where the session sets nothing else.
BATCH_BYTES = 8 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

_tables: list[tuple[dict, tuple[str, ...]]] = []


def worker_table(*users: str) -> dict:
    """A dictionary kept by a Python worker until it gets a task of a module that isn't among ``users``."""
    table: dict = {}
    _tables.append((table, users))
    return table


def release(user: str) -> None:
    """Empty the tables that tasks of other modules left in this worker."""
    for table, users in _tables:
        if user not in users:
            table.clear()


def arrow_map(df: DataFrame, function: Callable, schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` with this package on the executors; a worker holds the tables of one operator at a time."""
    ship(df.sparkSession)
    if BATCH_SETTING not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(BATCH_SETTING, BATCH_BYTES)
    user = function.__module__.rpartition(".")[2]

    def run(batches: Iterator) -> Iterator:
        release(user)
        return function(batches)

    return df.mapInArrow(run, schema)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage durably."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as keep it from clashing with a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def quoted(names: list[str]) -> list[Column]:
    """Top-level columns whatever their names hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. ASCII-only text takes the byte-wise built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


#: Places of the bitmap in ``flagged``: for each key, and at most (some 8 MB as a broadcast table).
PLACES, MOST_PLACES = 16, 1 << 24


def flagged(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with a column ``flag``: true for all whose keys are in ``wanted``, and for some 1 in ``PLACES`` others.

    The hashes of the wanted keys make a bitmap that is broadcast, so that rows without a flag need no shuffle to be told apart.
    From a million wanted keys on it grows no more and others get a flag more often: an exact join must follow.
    """
    places = min(MOST_PLACES, max(64, PLACES * wanted.count()))
    place = F.pmod(F.xxhash64(*keys), F.lit(places))
    bit = F.expr("shiftleft(1L, cast(flag_place & 63 as int))")
    pages = wanted.select(place.alias("flag_place")).groupBy(F.shiftright("flag_place", 6).alias("flag_page")).agg(F.bit_or(bit).alias("flag_bits"))
    pages = materialise(pages, "pages")
    rows = rows.withColumn("flag_place", place).withColumn("flag_page", F.shiftright("flag_place", 6))
    met = rows.join(F.broadcast(pages), "flag_page", "left")
    return met.withColumn("flag", F.coalesce(F.col("flag_bits").bitwiseAND(bit) != 0, F.lit(False))).drop("flag_page", "flag_place", "flag_bits")


def components(edges: DataFrame, name: str = "components", rounds: int = 60) -> DataFrame:
    """Smallest reachable vertex of every vertex that has an edge: columns ``v``, ``root``.

    ``edges`` has two bigint columns ``a`` and ``b``. Alternates the large-star and
    small-star steps; each step is one partial aggregation (a hub's neighbours are
    reduced before the shuffle) and one join that adaptive execution may split, and each
    round is written to the shared folder. Only a row count and a checksum reach the
    driver. An empty input gives an empty output.
    """
    e = materialise(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        name,
    )
    seen = None
    for _ in range(rounds):
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            break
        seen = mark
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        old, e = e, materialise(small.distinct(), name)
        discard(old)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).union(e.select("v", F.col("v").alias("root")).distinct())
