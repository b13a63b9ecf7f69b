"""Runs of word-processing files on pages, tables and pictures included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.lookups import PAGE_SIZES, heading_size
from quillspark.functions.strings import heading_digits
from quillspark.operators.templates import paginate

MARGIN = 56.0
LEADING = 1.3
AFTER, AFTER_TABLE, EMPTY = 4.0, 8.0, 14.0
SIZE, ADVANCE = 12.0, 0.5
ROW, CELL_PADDING = 20.0, 4.0
INDENT, BULLET = 18.0, 2


def with_targets(runs: DataFrame, rels: DataFrame) -> DataFrame:
    """``runs`` with image_target, the file that a picture's relationship names (null where it names none)."""
    named = rels.where("rel_id IS NOT NULL").select("path", F.col("rel_id").alias("image_rel"), F.col("target").alias("image_target"))
    return runs.join(named, ["path", "image_rel"], "left")


def table_columns(runs: DataFrame) -> DataFrame:
    """path, table_seq, n_cols (of the widest row, a cell that spans several counted so), n_rows."""
    cells = runs.where("table_seq IS NOT NULL").groupBy("path", "table_seq", "row", "col").agg(F.max("grid_span").alias("span"))
    rows = cells.groupBy("path", "table_seq", "row").agg(F.sum("span").alias("wide"))
    return rows.groupBy("path", "table_seq").agg(F.max("wide").cast("int").alias("n_cols"), F.count("*").cast("int").alias("n_rows"))


def line_estimate(chars: Column, size: Column, width: Column) -> Column:
    """Lines that so many characters take, one at least."""
    return F.greatest(F.lit(1.0), F.ceil(chars * ADVANCE * size / width))


def _paragraphs(runs: DataFrame, width: float) -> DataFrame:
    """path, block, kind, height, gap of paragraphs with text, and empty ones."""
    level = F.when(F.lower(F.coalesce("style", F.lit(""))).startswith("heading"), heading_digits(F.col("style"))).otherwise(0)
    own = F.when(F.coalesce("font_size", F.lit(0.0)) > 0, F.col("font_size")).otherwise(SIZE)
    size = F.when((level > 0) & (own == SIZE), heading_size(level)).otherwise(own)
    p = runs.where("table_seq IS NULL AND error IS NULL").withColumn("size", size).withColumn("said", F.coalesce(F.length("text"), F.lit(0)))
    p = p.groupBy("path", "block").agg(
        F.sum("said").alias("chars"), F.max(F.when(F.col("said") > 0, F.col("size"))).alias("tallest"), F.first("is_list").alias("listed"), F.first("list_level").alias("level"),
        F.min_by(F.when(F.col("said") > 0, F.col("size")), F.when(F.col("said") > 0, F.col("run_seq"))).alias("first"), F.count("run_seq").alias("n_runs"),
    )
    listed = F.coalesce("listed", F.lit(False))
    room = width - F.when(listed, (F.coalesce("level", F.lit(0)) + 1) * INDENT).otherwise(0.0)
    begin = F.when(listed, SIZE).otherwise(F.col("first"))
    tall = F.greatest("tallest", F.when(listed, SIZE))
    lines = line_estimate(F.col("chars") + F.when(listed, BULLET).otherwise(0), begin, room)
    some = (F.col("chars") > 0) | listed
    height = F.when(some, tall * LEADING * lines).otherwise(0.0)
    gap = F.when(some, AFTER).when(F.col("n_runs") == 0, EMPTY).otherwise(0.0)
    return p.select("path", "block", F.lit(1).alias("ord"), F.when(some, "paragraph").otherwise("space").alias("kind"), height.alias("height"), gap.alias("gap"))


def _pictures(runs: DataFrame, width: float) -> DataFrame:
    scale = F.least(F.lit(1.0), F.try_divide(F.lit(width * 0.9), F.col("image_w")))
    rows = runs.where("image_rel IS NOT NULL AND table_seq IS NULL")
    return rows.select("path", "block", F.lit(0).alias("ord"), F.lit("image").alias("kind"), F.coalesce(F.col("image_h") * scale, F.lit(0.0)).alias("height"), F.lit(AFTER).alias("gap"))


def _rows(runs: DataFrame) -> DataFrame:
    cells = runs.where("table_seq IS NOT NULL").groupBy("path", "block", "row", "col").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("para_seq", "run_seq", "text"))), lambda r: r["text"]), "").alias("text"), F.count_distinct("para_seq").alias("n")
    )
    lines = F.greatest(F.size(F.split("text", "\n")), F.col("n"))
    rows = cells.groupBy("path", "block", "row").agg(F.greatest(F.lit(ROW), F.max(SIZE * LEADING * lines + 2 * CELL_PADDING)).alias("height"))
    return rows.select("path", "block", F.col("row").alias("ord"), F.lit("row").alias("kind"), "height", F.lit(0.0).alias("gap"))


def layout_blocks(runs: DataFrame, page_size: str = "A4") -> DataFrame:
    """path, block, kind (paragraph, image, row), page (from 0), top, height: where each paragraph, picture and table row of a file goes.

    A paragraph is as high as its lines, estimated from its characters; a picture keeps its shape within nine tenths of the text's
    width; a row is as high as its highest cell. What does not fit goes to the next page. Files that cannot be read, and empty
    ones, have no rows. A file's blocks are one row while pages are broken.
    """
    w, h = PAGE_SIZES.get(page_size.upper(), PAGE_SIZES["A4"])
    width = w - 2 * MARGIN
    items = _paragraphs(runs, width).unionByName(_pictures(runs, width)).unionByName(_rows(runs))
    tables = items.where("kind = 'row'").groupBy("path", "block").agg(F.max("ord").alias("last"))
    items = items.join(tables, ["path", "block"], "left").withColumn("gap", F.when((F.col("kind") == "row") & (F.col("ord") == F.col("last")), AFTER_TABLE).otherwise(F.col("gap"))).drop("last")
    placed = paginate(items, ["path"], ["block", "ord", "kind"], "height", h - 2 * MARGIN, after="gap")
    return placed.where("kind <> 'space'").select("path", "block", "kind", "page", (F.col("top") + MARGIN).alias("top"), "height")
