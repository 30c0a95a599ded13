"""Benchmark passages inside documents: MinHash containment search, then exact containment.

An item's bottom-k MinHash sketch is a sample of its shingles, and the share of the sample that a
document holds estimates how much of the item the document contains, whatever the document's
length.  Items are partitioned by size (powers of two) and k follows the partition: a document
that holds at least t of an item lacks at most (1-t) n of its shingles, so with one more than that
in the sketch at least one of them must be met and no leak escapes the search.  Documents smaller
than the least share of an item are pruned against its partition.  Candidates are then verified on
the full shingle sets of item and document.

DataFrame operations only.  Documents are not shuffled by the search: their shingles probe a
broadcast table of sketches, whose size is checked first; a larger one is joined by hash instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Workspace

WIDTH = 5
THRESHOLD_PERCENT = 75
#: Rows of 16 bytes that are broadcast at most; beyond that both sides are shuffled.
BROADCAST_ROWS = 1_000_000
_SPACE = " \t\n\x0b\x0c\r"


def _checked(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def shingled(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and ``hs``: the distinct shingle hashes of the whole text.

    Words are runs of anything but ASCII white space after lower-casing A-Z; fewer than WIDTH
    words are one shingle; a text without words has none.
    """
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    df = docs.select(*keep, F.btrim(low, F.lit(_SPACE)).alias("t"))
    df = df.select(*keep, F.when(F.col("t") == "", F.array().cast("array<string>")).otherwise(F.split("t", r"[ \t-\r]+")).alias("w"))
    df = df.select(*keep, F.transform("w", lambda x: F.xxhash64(x)).alias("hw"))
    hw = F.col("hw")
    windows = F.transform(F.slice(hw, F.lit(1), F.size(hw) - (WIDTH - 1)), lambda x, i: F.xxhash64(x, *(F.get(hw, i + k) for k in range(1, WIDTH))))
    short = F.when(F.size(hw) > 0, F.array(F.xxhash64(F.array_join(F.transform(hw, lambda x: x.cast("string")), " ")))).otherwise(F.array().cast("array<bigint>"))
    return df.select(*keep, F.array_distinct(F.when(F.size(hw) >= WIDTH, windows).otherwise(short)).alias("hs"))


def _least(n: Column, percent: int) -> Column:
    """The fewest shingles out of n that reach the share."""
    return F.ceil(n * percent / F.lit(100)).cast("long")


def sketches(items: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """(item_id, n_item, size_class, h): the bottom-k sketch of each row of (item_id, hs)."""
    sized = items.where(F.size("hs") > 0).select("item_id", F.size("hs").cast("long").alias("n_item"), "hs")
    sized = sized.withColumn("size_class", F.floor(F.log2("n_item")).cast("int"))
    # the largest item of the partition may lack so many shingles; one more is always met
    largest = F.pow(F.lit(2), F.col("size_class") + 1) - 1
    k = F.least(F.col("n_item"), (F.floor(largest * (100 - percent) / 100) + 1).cast("long")).cast("int")
    sized = sized.select("item_id", "n_item", "size_class", F.slice(F.sort_array("hs"), F.lit(1), k).alias("hs"))
    return sized.select("item_id", "n_item", "size_class", F.explode("hs").alias("h"))


def _exploded(sets: DataFrame, size_name: str, *keep: str) -> DataFrame:
    """A row (keep..., size, h) for each shingle.

    The size is taken before the explode, or each row would carry the whole set.  The outer form
    keeps the optimizer from testing the set's size below the steps that make the set, where it
    would repeat all of them for each word.
    """
    sized = sets.select(*keep, F.size("hs").cast("long").alias(size_name), "hs")
    return sized.select(*keep, size_name, F.explode_outer("hs").alias("h")).where("h is not null")


def _contained(docs: DataFrame, benchmark: DataFrame, percent: int) -> DataFrame:
    """Rows doc_id, text_md5, item_id, n_item, n_shared: one per row of ``docs`` and item in it."""
    spark = docs.sparkSession
    ws = Workspace(spark, "decontam")
    # rows that repeat an item's id stay apart by a number that is stored
    items = ws.write(shingled(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", F.monotonically_increasing_id().alias("item")), "item_id", "item"), "items")
    bench = _exploded(items, "n_item", "item", "item_id")
    sampled = ws.write(sketches(items.select(F.col("item").alias("item_id"), "hs"), percent).withColumnRenamed("item_id", "item"), "sketches")

    # a document is known by its id and a digest of its text, so rows that share an id stay apart
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "text")
    probes = _exploded(shingled(ids, "doc_id", "text_md5"), "n_doc", "doc_id", "text_md5")
    met = probes.join(_checked(sampled), "h").where(F.col("n_doc") >= _least(F.col("n_item"), percent))
    candidates = ws.write(met.select(F.col("doc_id").alias("c_id"), F.col("text_md5").alias("c_md5")).distinct(), "candidates")

    this = F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_md5") == F.col("c_md5"))
    found = ids.withColumn("row", F.monotonically_increasing_id()).join(_checked(candidates), this, "left_semi")
    held = _exploded(shingled(found, "doc_id", "text_md5", "row"), "n_doc", "doc_id", "text_md5", "row").join(_checked(bench), "h")
    shared = held.groupBy("doc_id", "text_md5", "row", "item", "item_id", "n_item").agg(F.count("*").alias("n_shared"))
    return shared.where(F.col("n_shared") >= _least(F.col("n_item"), percent)).select("doc_id", "text_md5", "item_id", "n_item", "n_shared")


def leaks(docs: DataFrame, benchmark: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per document and item it contains: doc_id, item_id, n_item, n_shared, containment.

    ``docs`` needs doc_id and text, ``benchmark`` item_id and text; other columns are ignored.
    A document contains an item if it holds at least ``percent`` % of the item's distinct
    five-word shingles.

    Defined results: null and wordless texts contain nothing and are contained in nothing; an item
    of fewer than five words is one shingle that only a document of just these words holds; a
    null id stays null; rows that repeat a document or an item each give their rows, and rows that
    share an id with different texts are judged one by one.  An empty table on either side gives
    no rows.
    """
    return _contained(docs, benchmark, percent).select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of ``docs`` that contain no benchmark item, with all their columns.

    A row goes for its own text alone: rows that share its id, or are without one too, stay if
    their texts are clean.
    """
    mine, digest = "_glyphlake_leaked_id", "_glyphlake_leaked_md5"  # names that no table has
    found = Workspace(docs.sparkSession, "decontam").write(_contained(docs, benchmark, percent).select(F.col("doc_id").alias(mine), F.col("text_md5").alias(digest)).distinct(), "leaked")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(mine)) & (F.md5(F.col("text").cast("binary")) == F.col(digest))
    return docs.join(_checked(found), same, "left_anti")
