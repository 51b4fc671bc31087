"""Mixing sources to target weights: a low-discrepancy schedule of sources over equal-token blocks of shuffled documents.

1. Every document has a size in words, read once. Sources in code-point order (null last) take the given weights in
   turn and share all words; a source stops at ``most`` times its size, and what is over goes to the others by
   weight until none is above (one pass over the sources, by rising size for their weight).
2. Documents of a source are shuffled by a hash of id and text and laid end to end, ``most`` times over; the first
   ``target`` words (rounded) are cut into blocks of ``block`` words, the last one shorter. Places in the
   shuffled order are running sums in two levels: within ranges of the hash, and over the ranges' totals.
3. Slots are numbered from 0; the golden ratio's multiples, modulo one, map each slot through the sources'
   cumulative targets to a source. A slot's rank among the slots of its source (again running counts in two levels: within chunks
   of slots, and over chunks) is the number of the block that it takes.
4. Blocks and slots join by source and number. A few slots find no block and stay out; as many blocks find no slot
   and follow at the end, in rounds. So every block has one place, and a source's taken words are its target, rounded.

The golden ratio's points spread each source evenly over any stretch of the schedule. All of it is integer
arithmetic on content, so that reruns agree whatever the partitioning.

Cases: null text has size 0; a null source is a source of its own, the last; documents of size 0 are never
taken; rows that are equal in id and text are interchangeable; null ids are shuffled by their text; without
words all targets are 0; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogen.llm.shared import discard, materialise

#: Words: runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]"
#: Documents of a range of the shuffled order, about; slots of a chunk as a power of two.
RANGE_ROWS, CHUNK_BITS = 8192, 16
#: Bits of the shuffle's hash, of a golden-ratio point, and of the cells by which points find their source.
HASH_BITS, POINT_BITS, CELL_BITS = 60, 32, 14
#: 2 ** 32 over the golden ratio.
GOLDEN = 2654435769


def words(text: Column) -> Column:
    """Number of words, without holding them apart: each becomes one letter."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    marks = F.regexp_replace(text, f"{SPACE}*+{WORD}++{SPACE}*+", "x")
    return F.when(text.rlike(WORD), F.length(marks)).otherwise(0).cast("bigint")


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """``doc_id, source, key, size, h`` of every row; ``key`` is the source, never null."""
    text, source = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(source_col).cast("string")
    mark = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text).cast("binary"))
    h = F.conv(F.substring(mark, 1, HASH_BITS // 4), 16, 10).cast("bigint")
    rows = docs.select(F.col(id_col).alias("doc_id"), source.alias("source"), F.coalesce(F.concat(F.lit("s"), source), F.lit("")).alias("key"), words(F.col(text_col)).alias("size"), h.alias("h"))
    return materialise(rows, "mixing-sizes")


def shares(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """``key, source_size, docs, target, goal, low, high`` of every source: one row each, targets as above, ``goal`` the target in whole words, ``low`` and ``high`` its part of the points."""
    common = math.lcm(*weights)
    order = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    rows = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")).withColumn("turn", order)
    weight, step = F.lit(weights[-1]), F.col("turn") % len(weights)
    for i, w in enumerate(weights[:-1]):
        weight = F.when(step == i, w).otherwise(weight)
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    rows = rows.withColumn("weight", weight.cast("bigint"))
    rising = Window.orderBy(F.col("source_size") * (F.lit(common) / F.col("weight")).cast("bigint"), "turn")
    before, everything = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rows = rows.withColumns({
        "whole": F.sum("source_size").over(everything),
        "stopped": F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)),
        "open": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    full = (exact("whole") - exact("stopped")) * F.col("weight") > exact("source_size") * most * F.col("open")
    rows = rows.withColumn("full", full)
    left = F.col("whole") - F.coalesce(F.sum(F.when(F.col("full"), most * F.col("source_size"))).over(everything), F.lit(0))
    free = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything)
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise((F.col("weight") * left).cast("double") / free)
    rows = rows.withColumn("target", target).withColumn("goal", F.floor(F.col("target") + 0.5).cast("bigint"))
    upto = Window.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = lambda c: F.expr(f"coalesce(cast({c} as decimal(25,0)) * {1 << POINT_BITS} div nullif(all_goal, 0), 0)")
    rows = rows.withColumns({"goal_sum": F.sum("goal").over(upto), "all_goal": F.sum("goal").over(everything)})
    rows = rows.select("source", "key", "source_size", "docs", "target", "goal", cut("goal_sum - goal").alias("low"), cut("goal_sum").alias("high"))
    return materialise(rows, "mixing-sources")


def shuffled(sizes: DataFrame, docs: int) -> DataFrame:
    """``sizes`` and ``start``, the words before a document in its source's shuffled order."""
    bits = min(HASH_BITS - 1, max(0, math.ceil(math.log2(max(1, docs / RANGE_ROWS)))))
    rows = sizes.withColumn("range", F.shiftright("h", HASH_BITS - bits))
    inner = Window.partitionBy("key", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("inner", F.sum("size").over(inner) - F.col("size"))
    outer = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = sizes.withColumn("range", F.shiftright("h", HASH_BITS - bits)).groupBy("key", "range").agg(F.sum("size").alias("held"))
    totals = totals.select("key", "range", (F.sum("held").over(outer) - F.col("held")).alias("outer"))
    return rows.join(totals, ["key", "range"]).withColumn("start", F.col("inner") + F.col("outer")).drop("range", "inner", "outer")


def schedule(spark, sources: DataFrame, slots: int) -> DataFrame:
    """``slot, key, rank`` of the slots: the source of each and its number among that source's slots."""
    point = F.pmod(F.pmod(F.col("id"), F.lit(1 << 31)) * GOLDEN, F.lit(1 << POINT_BITS))
    cell = POINT_BITS - CELL_BITS
    parts = sources.where("low < high").select("key", "low", "high", F.explode(F.sequence(F.shiftright("low", cell), F.shiftright(F.col("high") - 1, cell))).alias("cell"))
    ids = spark.range(slots).select(F.col("id").alias("slot"), point.alias("point")).withColumn("cell", F.shiftright("point", cell))
    found = ids.join(parts, "cell").where("low <= point and point < high").select("slot", "key", F.shiftright("slot", CHUNK_BITS).alias("chunk"))
    inner = Window.partitionBy("key", "chunk").orderBy("slot")
    ranked = found.withColumn("inner", F.row_number().over(inner) - 1)
    outer = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = found.groupBy("key", "chunk").agg(F.count(F.lit(1)).alias("held"))
    totals = totals.select("key", "chunk", (F.sum("held").over(outer) - F.col("held")).alias("outer"))
    return ranked.join(totals, ["key", "chunk"]).select("slot", "key", (F.col("inner") + F.col("outer")).alias("rank"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = (5, 2, 1), most: int = 3, block: int = 256, seed: int = 13) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as pieces, the documents in their shuffled order, and the sources.

    Pieces are ``slot, key, block, place, doc_id, doc_start, from, length``: ``length`` words of a document from
    its word ``from`` on, at ``place`` in a block of its source, read in the order of ``slot, key, place``.
    """
    spark = docs.sparkSession
    sizes = sized(docs, id_col, text_col, source_col, seed)
    sources = shares(sizes, weights, most)
    count = sources.agg(F.sum("docs").alias("docs"), F.sum(F.ceil(F.col("goal") / block)).alias("slots")).first()
    order = materialise(shuffled(sizes, count["docs"] or 0), "mixing-order")
    discard(sizes)
    laid = order.where("size > 0").join(sources.select("key", "source_size", "goal"), "key").where("start < goal")
    laid = laid.withColumn("at", F.explode(F.expr("transform(sequence(0L, (goal - 1 - start) div source_size), e -> e * source_size + start)")))
    laid = laid.withColumn("end", F.least(F.col("at") + F.col("size"), "goal"))
    laid = laid.withColumn("block", F.explode(F.expr(f"sequence(at div {block}, (end - 1) div {block})")))
    laid = laid.withColumn("low", F.greatest("at", F.col("block") * block))
    pieces = laid.select("key", "block", "doc_id", F.col("start").alias("doc_start"), (F.col("low") - F.col("at")).alias("from"), (F.col("low") - F.col("block") * block).alias("place"), (F.least("end", (F.col("block") + 1) * block) - F.col("low")).alias("length"))
    slots = int(count["slots"] or 0)
    due = schedule(spark, sources, slots).withColumnRenamed("rank", "block")
    joined = pieces.join(due, ["key", "block"], "left")
    return joined.select(F.coalesce("slot", F.col("block") + slots).alias("slot"), "key", "block", "place", "doc_id", "doc_start", "from", "length"), order, sources


def taken(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every row: the words that the pieces of the mix take of it."""
    pieces, order, sources = mix(docs, **options)
    # a document with words has a start of its own in its source
    sums = pieces.groupBy("key", F.col("doc_start").alias("start")).agg(F.sum("length").alias("taken"), F.lit(True).alias("sized"))
    rows = order.withColumn("sized", F.col("size") > 0).join(sums, ["key", "start", "sized"], "left").join(sources.select("key", "source_size", "target"), "key")
    return rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
