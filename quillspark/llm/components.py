"""Connected components by alternating large-star and small-star rounds.

Each round is two aggregations and two joins over the edge table; hub keys are pre-aggregated on
the map side. A round's minima are written before they are joined, so that both sides of the join are
dealt anew and adaptive execution can divide a hub. The edges never leave the executors; the driver
sees a count and a checksum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.scratch import discard, materialize


def _large_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _small_star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "minima")
    pairs = F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))
    flat = edges.join(least, "u").select(F.explode(pairs).alias("p")).where("p.a <> p.b")
    return flat.select(F.col("p.a").alias("u"), F.col("p.b").alias("v")).distinct(), least


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges`` (u, v: bigint) but the roots themselves; root is the smallest node.

    Nulls, loops and repeated edges are ignored. No edges, no rows.
    """
    sides = F.struct(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now = materialize(edges.where("u <> v").select(sides.alias("e")).select("e.u", "e.v").distinct(), "edges")
    mark = None
    while True:
        seen = now.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
        if seen["n"] == 0 or (seen["n"], seen["x"]) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = (seen["n"], seen["x"])
        large, minima = _large_star(now)
        half = materialize(large, "edges")
        small, minima_of_half = _small_star(half)
        then, now = now, materialize(small, "edges")
        for x in (then, minima, half, minima_of_half):
            discard(x)
