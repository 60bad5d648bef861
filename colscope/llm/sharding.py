"""Balanced contiguous sharding by bytes: global prefix sums from per-partition totals, cut at equal targets.

DataFrame operations only. The text itself is never shuffled: only (id, size, checksum) rows are range-partitioned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpoint, read


def shard_by_bytes(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, law, shard, slot, grown_shard.

    Rows are ordered by id (null first), checksum and position in the input, so repeated rows and ties have a fixed place.
    A row's size is its UTF-8 bytes plus one (null text: 1). The row whose middle byte lies in the k-th of ``shards``
    equal parts of all bytes goes to shard k: shards are contiguous and off their target by half a row at each end.
    ``slot`` counts from 0 in each shard. An empty input gives no rows.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bare = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("_cs_id"),
        (F.octet_length(bare).cast("long") + 1).alias("_cs_size"),
        F.crc32(bare.cast("binary")).alias("_cs_crc"),
        F.monotonically_increasing_id().alias("_cs_at"),
    )
    key = [F.col("_cs_id").asc_nulls_first(), F.col("_cs_crc"), F.col("_cs_at")]
    # Written once, so that the partition numbers below can't change when a lost executor's work is done again.
    rows = checkpoint(rows.repartitionByRange(n, *key).withColumn("_cs_part", F.spark_partition_id()))
    # One row per partition, so the single-task windows here see as many rows as there are partitions, never the data.
    before = Window.orderBy("_cs_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        rows.groupBy("_cs_part").agg(F.sum("_cs_size").alias("b"), F.count("*").alias("n"))
        .select("_cs_part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_cs_b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_cs_n0"), F.sum("b").over(Window.partitionBy()).alias("_cs_all"))
    )
    inside = Window.partitionBy("_cs_part").orderBy(*key)
    placed = (
        rows.select("*", F.sum("_cs_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("_cs_end"), F.row_number().over(inside).alias("_cs_row"))
        .join(F.broadcast(totals), "_cs_part")
        .select(
            "_cs_id", "_cs_size", "_cs_crc", "_cs_part",
            F.expr(f"cast(((2 * (_cs_b0 + _cs_end) - _cs_size) * {shards}) div (2 * _cs_all) as int)").alias("_cs_shard"),
            (F.col("_cs_n0") + F.col("_cs_row") - 1).alias("_cs_seq"),
        )
    )
    first = placed.groupBy("_cs_shard").agg(F.min("_cs_seq").alias("_cs_first"))  # a row per shard
    return placed.join(F.broadcast(first), "_cs_shard").select(
        F.col("_cs_id").alias(id_col), F.col("_cs_size").alias("size"), F.col("_cs_crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        F.col("_cs_shard").alias("shard"), (F.col("_cs_seq") - F.col("_cs_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(read(spark, sf_dir, "documents"), shards=8)
