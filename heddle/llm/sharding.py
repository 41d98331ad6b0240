"""Contiguous shards of nearly equal size: global prefix sums of row sizes from per-partition totals,
cut at equal targets. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm.common import pick
from heddle.session import cut


def balanced_shards(docs: DataFrame, shards: int) -> DataFrame:
    """Every row of docs(doc_id, text) with size, text_crc32, shard (0 to shards - 1) and slot (0, 1, ... inside its shard).

    Rows stand in the order of (doc_id, size, crc32, place in the input); nulls come first. A shard is an
    unbroken stretch of that order: a row goes to the shard in whose equal share of all bytes its middle byte lies,
    so that shard sizes differ from the target by at most one row at either end. size is UTF-8 bytes plus 1; a null text
    has size 1 and the checksum of no bytes. Repeated rows keep a place each. A shard may stay empty where a
    row is larger than a share. An empty table gives no rows.

    The order is range-partitioned over all sort columns, so equal ids (or a third of the rows under one id) spread over
    many partitions. It is written once: the totals and the places must see the same cut. Only one row a partition
    meets in the prefix sum.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = pick(docs, "doc_id", "text").select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    order = ["doc_id", "size", "text_crc32", "place"]
    placed = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(W.partitionBy()).alias("all_bytes"),
    )
    inside = W.partitionBy("part").orderBy(*order)
    upto = inside.rowsBetween(W.unboundedPreceding, -1)
    located = (
        placed.withColumn("inner_bytes", F.coalesce(F.sum("size").over(upto), F.lit(0)))
        .withColumn("inner_rows", F.row_number().over(inside) - 1)
        .join(starts, "part")
        .withColumn("middle", (F.col("bytes_before") + F.col("inner_bytes")) * 2 + F.col("size"))
        # decimals: the product may pass 64 bits
        .withColumn("shard", F.floor(F.col("middle").cast("decimal(25,0)") * shards / (F.col("all_bytes") * 2)).cast("int"))
        .withColumn("place", F.col("rows_before") + F.col("inner_rows"))
        .select("doc_id", "size", "text_crc32", "shard", "place")
    )
    firsts = located.groupBy("shard").agg(F.min("place").alias("first_place"))
    return located.join(firsts, "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first_place")).cast("long").alias("slot")
    )

