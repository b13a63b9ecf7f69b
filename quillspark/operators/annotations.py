"""Annotations: list, add, delete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.colors import format_hex

#: Subtypes that are not annotations of the user's, and the public names of the others.
SYSTEM_SUBTYPES = ("Widget", "Link", "Popup", "TrapNet", "PrinterMark")
PUBLIC_TYPES = {"Highlight": "highlight", "Text": "note", "Ink": "freehand"}


def list_annotations(raw: DataFrame) -> DataFrame:
    """Annotations from raw rows (doc_id, page_index, seq, subtype, llx, lly, urx, ury, r, g, b, contents, page_w, page_h)."""
    kind = F.lower("subtype")
    for subtype, name in PUBLIC_TYPES.items():
        kind = F.when(F.col("subtype") == subtype, name).otherwise(kind)
    whole = lambda c: F.round(c).cast("int").cast("string")
    rows = raw.where(~F.col("subtype").isin(*SYSTEM_SUBTYPES)).withColumn("type", kind)
    return rows.select(
        "doc_id", "seq", F.concat_ws("_", F.col("page_index").cast("string"), whole(F.col("llx")), whole(F.col("lly")), "type").alias("id"), "type", "page_index",
        F.coalesce(format_hex(F.col("r"), F.col("g"), F.col("b")), F.lit("#000000")).alias("color"),
        (F.col("llx") / F.col("page_w")).alias("x"), (1 - F.col("ury") / F.col("page_h")).alias("y"),
        ((F.col("urx") - F.col("llx")) / F.col("page_w")).alias("width"), ((F.col("ury") - F.col("lly")) / F.col("page_h")).alias("height"),
        F.coalesce("contents", F.lit("")).alias("text"),
    )


def delete_first(annotations: DataFrame, doomed: DataFrame) -> DataFrame:
    """``annotations`` without the first of each (doc_id, id) in ``doomed``; ids are not unique."""
    n = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("page_index", "seq"))
    marked = annotations.withColumn("n", n).join(doomed.select("doc_id", "id", F.lit(True).alias("gone")).distinct(), ["doc_id", "id"], "left")
    return marked.where(~(F.coalesce("gone", F.lit(False)) & (F.col("n") == 1))).drop("n", "gone")


def add_annotations(pages: DataFrame, wanted: DataFrame, opacity: float = 0.5) -> DataFrame:
    """Rows to append: one for each rectangle of ``wanted`` (doc_id, page_index, type, color, opacity, text,
    rects ARRAY<STRUCT<x, y, width, height>>), in page space. Pages that don't exist are passed over."""
    each = wanted.select("doc_id", "page_index", "type", "color", F.coalesce("opacity", F.lit(opacity)).alias("opacity"), "text", F.explode("rects").alias("r"))
    return each.join(pages, ["doc_id", "page_index"]).select(
        "doc_id", "page_index", "type", "color", "opacity", "text", (F.col("r.x") * F.col("width")).alias("x"),
        ((1 - F.col("r.y") - F.col("r.height")) * F.col("height")).alias("y"), (F.col("r.width") * F.col("width")).alias("w"), (F.col("r.height") * F.col("height")).alias("h"),
    )


def freehand_box(points: DataFrame, keys: list[str], pad: float = 5.0) -> DataFrame:
    """Bounding box of strokes' points (x, y), padded."""
    return points.groupBy(*keys).agg((F.min("x") - pad).alias("llx"), (F.min("y") - pad).alias("lly"), (F.max("x") + pad).alias("urx"), (F.max("y") + pad).alias("ury"))
