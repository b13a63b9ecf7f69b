"""Outlines: trees as flat lists in pre-order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.scratch import discard, materialize

WIDTH = 20


def flatten(nodes: DataFrame) -> DataFrame:
    """doc_id, seq, node_id, title, level, children, path, parent of nodes (doc_id, node_id, parent_id, ord, title), in pre-order.

    The paths grow level by level until no node is left, whatever the depth; a level is one join on the parent, and is
    written before the next is made. Nodes without a way to a root are left out.
    """
    step = F.lpad(F.col("ord").cast("string"), WIDTH, "0")
    roots = nodes.where("parent_id IS NULL").select("doc_id", "node_id", F.lit(None).cast("bigint").alias("parent_id"), "title", F.lit(0).alias("level"), step.alias("path"))
    levels = [materialize(roots, "outline-level")]
    while not levels[-1].isEmpty():
        up = levels[-1].select("doc_id", F.col("node_id").alias("parent_id"), F.col("level").alias("up_level"), F.col("path").alias("up_path"))
        below = nodes.join(up, ["doc_id", "parent_id"]).select("doc_id", "node_id", "parent_id", "title", (F.col("up_level") + 1).alias("level"), F.concat("up_path", F.lit("/"), step).alias("path"))
        levels.append(materialize(below, "outline-level"))
    done = nodes.sparkSession.read.schema(levels[0].schema).parquet(*(x._quillspark_path for x in levels))
    direct = nodes.where("parent_id IS NOT NULL").groupBy("doc_id", F.col("parent_id").alias("node_id")).agg(F.count("*").cast("int").alias("children"))
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("path", "node_id")) - 1
    return done.join(direct, ["doc_id", "node_id"], "left").select("doc_id", seq.alias("seq"), "node_id", "parent_id", "title", "level", F.coalesce("children", F.lit(0)).alias("children"), "path")


def remove(flat: DataFrame, indexes: DataFrame) -> DataFrame:
    """``flat`` without the nodes at ``indexes`` (doc_id, seq) and all below them, numbered anew."""
    roots = flat.join(indexes.select("doc_id", "seq").distinct(), ["doc_id", "seq"]).select(F.col("doc_id").alias("r_doc"), F.col("path").alias("r_path"))
    below = (F.col("path") == F.col("r_path")) | F.startswith("path", F.concat("r_path", F.lit("/")))
    kept = flat.join(roots, (F.col("doc_id") == F.col("r_doc")) & below, "left_anti")
    return kept.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("path", "node_id")) - 1)


def add(flat: DataFrame, items: DataFrame) -> DataFrame:
    """``items`` (doc_id, ord, title, page_index, page_count, parent_index) as new nodes: doc_id, index, title, parent, level.

    Items on pages that don't exist are passed over and take no index. A parent index counts the present nodes in
    pre-order and then the items added so far; one that is out of range makes a root. A present parent is found
    by one join; chains of new items are followed by joins that double their reach.
    """
    have = flat.groupBy("doc_id").agg(F.count("*").cast("int").alias("have"))
    real = items.where("page_index >= 0 AND page_index < page_count").join(have, "doc_id", "left")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "title", "page_index", "parent_index"))
    numbered = real.withColumn("have", F.coalesce("have", F.lit(0))).withColumn("index", (F.col("have") + n - 1).cast("int"))
    p = F.col("parent_index")
    numbered = numbered.withColumn("parent", F.when((p >= 0) & (p < F.col("index")), p).otherwise(-1).cast("int"))
    present = flat.select("doc_id", F.col("seq").cast("int").alias("parent"), F.col("level").alias("up"))
    known = F.when(F.col("parent") < 0, 0).when(F.col("parent") < F.col("have"), F.col("up") + 1)
    state = numbered.join(present, ["doc_id", "parent"], "left").select("doc_id", "index", "title", "parent", known.cast("int").alias("level"), F.col("parent").alias("to"), F.lit(1).alias("steps"))
    state = materialize(state, "new-bookmarks")
    while not state.where("level IS NULL").isEmpty():
        there = state.select("doc_id", F.col("index").alias("to"), F.col("level").alias("to_level"), F.col("to").alias("next"), F.col("steps").alias("more"))
        open_ = F.col("level").isNull()
        hop = state.join(there, ["doc_id", "to"], "left").select(
            "doc_id", "index", "title", "parent", F.when(open_, F.col("to_level") + F.col("steps")).otherwise(F.col("level")).alias("level"),
            F.when(open_ & F.col("to_level").isNull(), F.col("next")).otherwise(F.col("to")).alias("to"),
            F.when(open_ & F.col("to_level").isNull(), F.col("steps") + F.col("more")).otherwise(F.col("steps")).alias("steps"),
        )
        then, state = state, materialize(hop, "new-bookmarks")
        discard(then)
    return state.select("doc_id", "index", "title", "parent", "level")
