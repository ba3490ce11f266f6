"""Operator 1: contiguous shards of near-equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photarium.sources.scratch import materialize


def shard_by_bytes(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal rows, in id order, into ``shards`` contiguous runs of near-equal bytes.

    Rows are range-partitioned once as narrow (id, size, crc) records. Each
    partition's total goes through one small prefix sum over partitions, which
    gives every row its global byte offset. A row belongs to the shard that holds
    the middle of its byte range, so a shard misses its target by less than the
    longest document.

    Returns ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.
    ``size`` is the UTF-8 length plus 1; a null text counts as no bytes and has
    the crc of the empty string. Null ids come first; equal ids are ordered by
    size and crc. Other columns of ``docs`` are not used. Empty input: no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    order = ["doc_id", "size", "text_crc32"]
    ranged = materialize(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranged")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("part_bytes"), F.count("*").alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the shuffle above, whatever the input's size.
    offsets = totals.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("row0"), F.sum("part_bytes").over(Window.partitionBy(F.lit(1))).alias("total"))

    inside = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumn("end_in", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("row_in", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), "part")
        .withColumn("twice_middle", 2 * (F.col("byte0") + F.col("end_in")) - F.col("size"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("twice_middle") * shards / (2 * F.col("total")))).cast("int"))
        .withColumn("row", F.col("row0") + F.col("row_in"))
        .select("doc_id", "size", "text_crc32", "shard", "row")
    )
    placed = materialize(placed, "placed")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # at most one row for each shard
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op1_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_by_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
