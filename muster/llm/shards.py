"""Contiguous shards of near-equal size from global prefix sums of bytes.

The rows' sizes, without their texts, are range-partitioned in id order and summed per partition.
The prefix sums of the partition totals (one row per partition) plus the running sum inside a
partition give each row's place in the whole byte range, which is cut at equal targets. A row goes
where its middle lies, so a shard's size differs from the target by less than the two rows at its
ends. Built-in functions only; partitions are bounded by the range sampling, because the order
ends in a number that is unique per row and so even equal ids are spread.

Law: ``bytes``. Defined results: a null text counts as 0 bytes, with the checksum of an empty one;
rows without id come first; rows equal in id, size and checksum follow each other in file order; a
row larger than the target may leave a shard empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from muster.session import cut_lineage

OVERHEAD = 16


def shard_by_bytes(docs: DataFrame, shards: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, size, text_crc32, law, shard, slot, grown_shard)``, one row per row of ``docs``."""
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    sized = cut_lineage(docs.select(
        F.col(key).alias("__key"), (F.octet_length(body) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(body).alias("crc"), F.monotonically_increasing_id().alias("__file_order")))
    order = ["__key", "size", "crc", "__file_order"]
    dealt = cut_lineage(sized.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    # One row per partition in ``totals`` and ``offsets``.
    totals = dealt.groupBy("__part").agg(F.sum("size").alias("bytes"))
    below = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select("__part", F.coalesce(F.sum("bytes").over(below), F.lit(0)).alias("__below"),
                            F.sum("bytes").over(W.partitionBy(F.lit(1))).alias("__all"))
    in_part = W.partitionBy("__part").orderBy(*order)
    summed = dealt.select("*", F.sum("size").over(in_part).alias("__to"), F.row_number().over(in_part).alias("__place"))
    # Twice the middle of the row's byte range over twice the total: whole numbers throughout.
    shard = F.expr(f"least({shards - 1}, (2 * (__below + __to) - size) * {shards} div (2 * __all))").cast("int")
    cut = cut_lineage(summed.join(offsets, "__part").withColumn("shard", shard))
    # Rows of a shard in a partition have consecutive places: one row per such piece.
    pieces = cut.groupBy("shard", "__part").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("rows"))
    earlier = W.partitionBy("shard").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = pieces.select(F.struct("shard", "__part").alias("__piece"), (
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"))
    starts = starts.select("__piece.*", "__shift")
    return cut.join(starts, ["shard", "__part"]).select(
        F.col("__key").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col("__place") + F.col("__shift")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
