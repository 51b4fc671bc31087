"""Exact deduplication through an extendible-hash index on shared files (DataFrame operations only).

1. Every text is normalised once (A-Z lower-cased) and written to the shared folder as an
   entry: 64-bit key, length, SHA-256, ``doc_id`` and the normalised text.
2. The directory is built by doubling. It starts with one bucket; a bucket of more than
   ``capacity`` keys is split by the next bit of the key, again and again, to all 64 bits if need be.
   One step of the loop looks at as many bits below an open prefix as its number of keys asks for (twice as many parts as
   buckets of ``capacity`` would be): it counts the keys of each part, gives each the
   shortest prefix of it that is not overfull, and goes on with the overfull parts alone. So a page of the directory has about
   as many rows as buckets. A bucket is a range of keys, named by its first key.
3. A key that one row holds needs no comparison. The rows of all others meet their keys, and are dealt to their buckets, in
   ``SLICES`` slices by the row's id: a task that gets a slice of a text that fills a third of the table sums it up there, and
   ``SLICES`` partial sums of it at most go on to its bucket.
4. The owner of a bucket compares the bytes of all texts of a key: equal ones become one entry, different
   ones are chained under the key. The entries, with the group's size and the id that stays, are
   written to the shared folder, and each row finds its own by slice, key, length and hash. Two chained texts of one
   length and SHA-256 would be an error, which the owner checks.

Cases: null text counts as empty; a null ``doc_id`` is kept only when its text has no other
row; repeated rows are members of the group like any other, and all rows that carry the
largest ``doc_id`` are marked kept; an empty table gives an empty table; other input
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orogen.llm.shared import ascii_lower, discard, materialise

SLICES = 16


def entries(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Normalised text, key, length, hash and slice (by id) of every row, in the shared folder."""
    norm = df.select(F.col(id_col).cast("bigint").alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("norm"))
    rows = norm.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(SLICES)).cast("int").alias("slice"), key_of(F.col("norm")).alias("key"), F.octet_length("norm").alias("size"), F.unhex(F.sha2("norm", 256)).alias("sha"), "norm")
    return materialise(rows, "exact-entries")


def bits_for(n: Column, low: Column, capacity: int) -> Column:
    """Bits to look at below a prefix of ``low`` bits and ``n`` keys."""
    return F.least(64 - low, F.greatest(F.lit(1), F.ceil(F.log2(n / F.lit(capacity))).cast("int") + 1)).cast("int")


def directory(keys: DataFrame, capacity: int) -> list[DataFrame]:
    """Pages of the directory: for the keys' first ``high`` bits (``part``) their bucket's ``depth``, or null and the ``next`` number of bits to look at.

    The first page is for all keys, each later one for the overfull parts of the page before it.
    """
    n = keys.count()
    open_ = keys.select("key", F.lit(0).alias("low"), bits_for(F.lit(float(max(n, 1))), F.lit(0), capacity).alias("high"))
    pages = []
    while True:
        counts = open_.groupBy("low", "high", F.expr("shiftrightunsigned(key, 64 - high)").alias("part")).agg(F.count(F.lit(1)).alias("n"))
        counts = materialise(counts, "exact-counts")
        levels = counts.select("high", "part", "n", F.explode(F.sequence(F.when(F.col("low") == 0, 0).otherwise(F.col("low") + 1), F.col("high"))).alias("depth"))
        levels = levels.withColumn("node", F.expr("if(depth = 0, 0, shiftrightunsigned(part, high - depth))"))
        held = levels.groupBy("depth", "node").agg(F.sum("n").alias("held"))
        fits = held.where((F.col("held") <= capacity) | (F.col("depth") == 64)).select("depth", "node")
        found = levels.join(fits, ["depth", "node"]).groupBy("high", "part").agg(F.min("depth").alias("depth"))
        page = counts.join(found, ["high", "part"], "left").withColumn("next", F.when(F.col("depth").isNull(), F.col("high") + bits_for(F.col("n"), F.col("high"), capacity)))
        pages.append(materialise(page.select("high", "part", "depth", "next"), "exact-directory"))
        discard(counts)
        if pages[-1].where("depth is null").isEmpty():
            return pages
        full = pages[-1].where("depth is null").select("high", "part", "next")
        open_ = open_.withColumn("part", F.expr("shiftrightunsigned(key, 64 - high)")).join(full, ["high", "part"]).select("key", F.col("high").alias("low"), F.col("next").alias("high"))


def place(keys: DataFrame, pages: list[DataFrame], capacity: int) -> DataFrame:
    """``keys`` with the ``bucket`` (its first key) and ``depth`` that the directory names."""
    first = pages[0].agg(F.max("high")).first()[0]
    done, rest = [], keys.withColumn("high", F.lit(first).cast("int"))
    for page in pages:
        seen = rest.withColumn("part", F.expr("shiftrightunsigned(key, 64 - high)")).join(page, ["high", "part"])
        bucket = F.expr("if(depth = 0, 0L, shiftleft(shiftrightunsigned(key, 64 - depth), 64 - depth))")
        done.append(seen.where("depth is not null").withColumn("bucket", bucket).drop("high", "part", "next"))
        rest = seen.where("depth is null").withColumn("high", F.col("next")).drop("part", "next", "depth")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def sliced(df: DataFrame) -> DataFrame:
    """A copy of every row for each slice."""
    return df.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))


def deal(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of keys that several rows hold, with their bucket; the rows of one key are dealt by slice."""
    return rows.join(sliced(keys.where("n > 1").select("key", "bucket")), ["key", "slice"])


def build_index(rows: DataFrame, capacity: int = 512) -> tuple[DataFrame, DataFrame]:
    """The buckets' keys (``key, n, bucket, depth``), and the chained entries of the keys that several rows hold; both on shared files."""
    counts = materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "exact-keys")
    pages = directory(counts.select("key"), capacity)
    keys = materialise(place(counts, pages, capacity), "exact-buckets")
    discard(counts, *pages)
    dealt = deal(rows, keys)
    sums = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    # a slice's rows of a key are in one task already: no exchange before these sums
    part = dealt.groupBy("bucket", "key", "slice", "norm").agg(*sums)
    # the bucket alone says which task owns it: gathering and chaining need no further exchange
    owned = part.repartition("bucket").groupBy("bucket", "key", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    owned = owned.select("bucket", "key", F.octet_length("norm").alias("size"), F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    chain = Window.partitionBy("bucket", "key").orderBy("size", "sha")
    owned = owned.withColumns({"chain": F.row_number().over(chain), "twin": F.lag("sha").over(chain)})
    fault = F.raise_error(F.lit("two texts share key, length and SHA-256"))
    owned = owned.withColumn("chain", F.when(F.col("twin") == F.col("sha"), fault.cast("int")).otherwise(F.col("chain"))).drop("twin")
    return keys, materialise(owned, "exact-index")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 512, key_of: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256, bucket, chain`` of every row; a text whose key no other row has is in no chain and has no bucket here."""
    rows = entries(df, id_col, text_col, key_of)
    _, index = build_index(rows, capacity)
    found = rows.select("doc_id", "key", "slice", "size", "sha").join(sliced(index), ["key", "slice", "size", "sha"], "left")
    alone = F.col("chain").isNull()
    found = found.withColumns({"keep_id": F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")), "group_size": F.when(alone, F.lit(1).cast("bigint")).otherwise(F.col("group_size"))})
    return found.select(
        "doc_id", "keep_id", "group_size",
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"), "bucket", F.coalesce("chain", F.lit(1)).alias("chain"),
    )
