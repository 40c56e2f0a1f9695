"""Contiguous shards of near-equal bytes from global prefix sums.

Rows are put in one total order (id, checksum, size, position of the row in its input), dealt to range
partitions, and only per-partition totals are summed up globally: a table with one row for each
partition. A row's global byte offset is the total of the partitions before it plus a running sum inside its own.
Cutting that line of bytes at equal targets gives contiguous shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored

#: Bytes that a row takes besides its text.
ROW_BYTES = 16


def shard_by_bytes(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: id, size, text_crc32, law, shard, slot, grown_shard.

    A shard takes the rows whose middle byte lies in its equal share of all bytes, so a shard is off its target by one
    row's size at most. slot counts from 0 inside a shard without gaps. Null texts have 0 bytes and the
    checksum 0; null ids come first; repeated rows each get a slot of their own; an empty table gives no
    rows; further columns of docs are ignored. Only ids, sizes and checksums are shuffled, never texts, and
    equal rows don't gather in one task, as the position of a row breaks ties.
    """
    spark = docs.sparkSession
    data = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    order = ["_id", "_crc", "_size", "_at"]
    slim = docs.select(
        F.col(id_col).alias("_id"),
        F.crc32(data).alias("_crc"),
        (F.octet_length(data).cast("long") + ROW_BYTES).alias("_size"),
        F.monotonically_increasing_id().alias("_at"),
    )
    ranged = stored(slim.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id()), "ranged")

    # One row for each range partition, so this window sees a few hundred rows at most.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(F.sum("_size").alias("_bytes"), F.count(F.lit(1)).alias("_rows"))
    bases = totals.select(
        "_part",
        F.coalesce(F.sum("_bytes").over(before), F.lit(0)).alias("_byte_base"),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_row_base"),
        F.sum("_bytes").over(Window.partitionBy()).alias("_all"),
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    end = F.sum("_size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_byte_base")
    placed = (
        ranged.join(F.broadcast(bases), "_part")
        .withColumn("_end", end)
        .withColumn("_row", F.row_number().over(inside) + F.col("_row_base") - 1)
        .withColumn("_shard", F.expr(f"cast(((2 * _end - _size) * {int(n_shards)}) div (2 * _all) as int)"))
    )
    # One row for each shard and partition it meets.
    firsts = placed.groupBy("_shard").agg(F.min("_row").alias("_first"))
    return placed.join(F.broadcast(firsts), "_shard").select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col("_shard").alias("shard"),
        (F.col("_row") - F.col("_first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
