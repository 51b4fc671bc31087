"""Line deduplication across documents (DataFrame operations only).

1. Every line's key (white space stripped at both ends, A-Z lower-cased) of at least
   ``min_chars`` code points becomes a 128-bit hash with its document and position; these
   narrow rows go to the shared folder once.
2. A frequent-items sketch proposes at most ``hot_keys`` very common keys; their first
   documents are found by a pre-aggregated minimum, and this small table (bounded by
   ``hot_keys`` rows) is broadcast to decide their lines where they are. The sketch only
   balances the load: any key may be on either path.
3. All other rows are range-partitioned by hash with a secondary sort by document and
   position; a streaming window hands each row the first document of its key. The lines
   that stay in no document but the first are dropped.
4. Dropped positions fold into one bitmap per document: 64-line words of keep bits, in
   which only words with a dropped line are stored. ``line_bitmaps`` returns these;
   ``apply_bitmaps`` gives the texts that remain.

Cases: a null or empty text is one empty line; a null ``doc_id`` counts as the largest id;
rows that repeat a ``doc_id`` are the same document, so what they share is not dropped
between them; a text whose lines all go becomes empty; an empty table gives an empty
table; ``apply_bitmaps`` keeps all other columns as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogen.llm.shared import ascii_lower, fresh, materialise

LAST = (1 << 63) - 1
SPACE = " \t\n\x0b\x0c\r"


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


def _row(id_col: str, text_col: str) -> tuple[Column, Column]:
    """What tells documents apart: the id (null last) and the text's hash."""
    return F.coalesce(F.col(id_col).cast("bigint"), F.lit(LAST)), F.xxhash64(_text(text_col))


def occurrences(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    rid, mark = _row(id_col, text_col)
    rows = df.select(rid.alias("rid"), mark.alias("mark"), F.posexplode(F.split(_text(text_col), "\n")).alias("pos", "line"))
    rows = rows.select("rid", "mark", "pos", ascii_lower(F.btrim("line", F.lit(SPACE))).alias("key")).where(F.length("key") >= min_chars)
    # the constant comes first: it changes the seed, while after the key it would hash h1 alone and h2 would tell nothing new
    return rows.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "rid", "mark", "pos")


def line_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, hot_keys: int = 512) -> DataFrame:
    """``rid, mark, keep`` of each document that loses lines; ``keep`` maps a word's number to its keep bits."""
    rows = materialise(occurrences(df, id_col, text_col, min_chars), "lines")
    top = rows.select(F.explode(F.expr(f"approx_top_k(h1, {hot_keys}, {16 * hot_keys})")).alias("t"))
    hot = rows.join(F.broadcast(top.select(F.col("t.item").alias("h1")).distinct()), "h1")
    hot = materialise(hot.groupBy("h1", "h2").agg(F.min("rid").alias("first")), "lines-hot")
    rest = rows.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti")
    ranged = rest.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", "rid", "pos")
    stream = Window.partitionBy("h1", "h2").orderBy("rid", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cold = ranged.select("rid", "mark", "pos", F.first("rid").over(stream).alias("first"))
    warm = rows.join(F.broadcast(hot), ["h1", "h2"]).select("rid", "mark", "pos", "first")
    dropped = cold.where("rid <> first").union(warm.where("rid <> first")).select("rid", "mark", "pos").repartition("rid", "mark")
    words = dropped.groupBy("rid", "mark", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
    return words.groupBy("rid", "mark").agg(F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits")))).alias("keep"))


def apply_bitmaps(df: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``df`` plus ``_n_lines``, ``_n_dropped`` and ``_kept_text`` (columns with these three names are replaced)."""
    row = _row(id_col, text_col)
    rid, mark, keep, lines, stay = own = fresh(df, "_rid", "_mark", "_keep", "_lines", "_stay")
    marks = bitmaps.select(F.col("rid").alias(rid), F.col("mark").alias(mark), F.col("keep").alias(keep))
    rows = df.withColumns({rid: row[0], mark: row[1]}).join(marks, [rid, mark], "left").withColumn(lines, F.split(_text(text_col), "\n"))
    word = f"coalesce(try_element_at({keep}, shiftright(i, 6)), -1L)"
    kept = F.expr(f"filter({lines}, (line, i) -> ({word} & shiftleft(1L, i % 64)) <> 0)")
    rows = rows.withColumn(stay, F.when(F.col(keep).isNull(), F.col(lines)).otherwise(kept))
    rows = rows.withColumns({"_n_lines": F.size(lines).cast("bigint"), "_n_dropped": (F.size(lines) - F.size(stay)).cast("bigint")})
    text = F.when(F.col(keep).isNull(), _text(text_col)).otherwise(F.array_join(stay, "\n"))
    return rows.withColumn("_kept_text", text).drop(*own)
