"""Contiguous shards of nearly equal bytes, by global prefix sums.

Only DataFrame operations: sizes and checksums are written once as a narrow table, rows are dealt
into ranges of doc_id, each range yields one total, a running sum over the totals (as many rows as
ranges) gives every range its base, and a running sum inside the range gives every document its
global byte and row position.  A shard is the target interval that holds the middle of the
document, so no shard differs from the target by more than one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .storage import Workspace, ranges

N_SHARDS = 40
ROW_OVERHEAD = 16


def byte_shards(docs: DataFrame, n_shards: int = N_SHARDS, row_overhead: int = ROW_OVERHEAD) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``docs`` needs doc_id and text; other columns are ignored.  Shards follow ascending doc_id.

    Defined results: a null text counts as no bytes and has checksum 0; null doc_ids come first;
    rows that repeat a doc_id keep the order of the table's files.  An empty table gives no rows.
    ``law`` is 'bytes' and ``grown_shard``, which belongs to another law, is null.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(row_overhead)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.monotonically_increasing_id().alias("row"))
    narrow = ws.write(narrow, "narrow")
    # ``row`` was stored above, so the order is total and the same in every attempt
    order = [F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    ranged = ws.write(narrow.repartitionByRange(ranges(narrow), *order).withColumn("range", F.spark_partition_id()), "ranged")

    totals = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # as many rows as ranges, which follow the bytes of the narrow table
    bases = totals.select("range", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base_bytes"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base_rows"), F.sum("bytes").over(whole).alias("total"))

    inside = Window.partitionBy("range").orderBy(*order)
    placed = ranged.select("*", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(inside).alias("nth")).join(F.broadcast(bases), "range")
    start = F.col("base_bytes") + F.col("upto") - F.col("size")
    # floor((2 start + size) n / (2 total)); decimals, since the product may pass 2^63 on huge tables
    middle = (F.lit(2).cast("decimal(20,0)") * start + F.col("size")) * F.lit(n_shards)
    shard = F.least(F.lit(n_shards - 1), F.floor(middle / (F.lit(2) * F.col("total")).cast("decimal(20,0)")).cast("int"))
    placed = ws.write(placed.select("doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("base_rows") + F.col("nth") - 1).alias("position")), "placed")
    first = placed.groupBy("shard").agg(F.min("position").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("position") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
