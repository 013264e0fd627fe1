"""Contiguous shards of near equal bytes from global prefix sums; DataFrame functions only.

Rows are put in order of ``doc_id`` (null first; ties by checksum, size and place in the table) by a range partitioning of
narrow rows. Totals per range partition, one row each, give the bases; a running sum inside each
partition does the rest, so no task sees more than its share. A document belongs to the shard in
which the middle of its byte span falls, so each cut is off by half a document at most.

Defined results: null text has no bytes (size 1, checksum 0); repeated rows are separate documents;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotlens.session import stored


def with_prefix_sums(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """Adds ``before`` (sum of ``value`` of all rows before) and ``rank`` (rows before) in the global order.

    ``rows`` should be narrow: they are written once to number them, so that equal rows fall into several ranges, and once
    sorted, as the range bounds of a recomputed partitioning could differ.
    """
    order = [*order, "row"]
    numbered = stored(rows, "rows").withColumn("row", F.monotonically_increasing_id())
    ranged = numbered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = stored(ranged, "ranged")
    totals = ranged.groupBy("part").agg(F.sum(value).alias("part_sum"), F.count("*").alias("part_rows"))
    # one row for each partition
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(
        "part",
        F.coalesce(F.sum("part_sum").over(earlier), F.lit(0)).alias("base_sum"),
        F.coalesce(F.sum("part_rows").over(earlier), F.lit(0)).alias("base_rows"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = ranged.select("*", F.sum(value).over(inside).alias("own_sum"), F.row_number().over(inside).alias("own_rank"))
    return running.join(F.broadcast(bases), "part").select(
        *rows.columns,
        (F.col("base_sum") + F.col("own_sum") - F.col(value)).alias("before"),
        (F.col("base_rows") + F.col("own_rank") - 1).alias("rank"),
    )


def shards(docs: DataFrame, count: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot (place in the shard), grown_shard (null: the law is not by key)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
    )
    placed = with_prefix_sums(rows, ["doc_id", "text_crc32", "size"], "size")
    total = stored(placed, "placed")
    whole = total.agg(F.sum("size")).first()[0] or 1
    # the middle of the document's span, in halves, times the shards, by twice the whole: all in integers
    cut = total.withColumn("shard", F.expr(f"CAST(least(((2 * before + size) * {count}) div (2 * {whole}L), {count - 1}) AS int)"))
    first = cut.groupBy("shard").agg(F.min("rank").alias("first"))
    return cut.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
