"""Positions in an order, without one task per key.

A key's rows are dealt over hash buckets; counts of the buckets give each bucket its offset, and rows are
numbered inside their bucket. A key that holds a third of all rows is spread over all buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.scratch import materialize

ROWS_PER_BUCKET = 4096


def size_class(size: Column) -> Column:
    """An int that grows with a long: sixteen classes to an octave; numbers under 32 have their own."""
    octave = F.greatest(F.length(F.bin(size)) - 5, F.lit(0))
    return (octave * 1000 + F.call_function("shiftright", size, octave)).cast("int")


def spread_rank(df: DataFrame, keys: list[str], spread: Column, order: list[str], name: str, rows: int) -> DataFrame:
    """``df`` with a long column ``name``: 0, 1, 2, ... within ``keys`` (no nulls there), by bucket and then ``order``.

    ``rows`` bounds the rows of ``df``; it gives the number of buckets, ``ROWS_PER_BUCKET`` rows to each, 16 at least. ``spread`` is a hash.
    """
    on = [*keys, "_bucket"]
    buckets = max(16, -(-rows // ROWS_PER_BUCKET))
    # Without this, rows that are dealt by ``keys`` already would stay so.
    b = df.withColumn("_bucket", F.pmod(spread, F.lit(buckets))).repartition(*on)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = b.groupBy(*on).agg(F.count("*").alias("_n")).select(*on, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy(*on).orderBy(*order)).cast("long") - 1
    return b.join(offsets, on).withColumn(name, inside + F.col("_offset")).drop("_bucket", "_offset")


def sorted_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df``, written out, with a long column ``name``: 0, 1, 2, ... in ``order``, by a range partitioning."""
    dealt = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)).cast("long") - 1
    return dealt.join(offsets, "_part").withColumn(name, inside + F.col("_offset")).drop("_part", "_offset")
