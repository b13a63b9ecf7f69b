"""Watermarks as layout rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.colors import parse_hex
from quillspark.functions.geometry import watermark_origin


def _target_pages(pages: DataFrame, only: DataFrame | None) -> DataFrame:
    return pages if only is None else pages.join(only.select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_semi")


def text_watermark(
    pages: DataFrame, text: str, only: DataFrame | None = None, *, opacity: float = 0.3, angle: float = 45.0, font_size: float = 48.0, color: str = "#FF0000", advance: float = 0.6
) -> DataFrame:
    """A row per page (all, or those in ``only``: doc_id, page_index): where the text begins, its turn, size, opacity and colour.

    The text is centred on the page and turned about its centre. ``advance``: width of a character at size 1.
    """
    at = watermark_origin(F.col("width"), F.col("height"), F.lit(len(text) * advance * font_size), F.lit(font_size), F.lit(angle))
    rows = _target_pages(pages, only).withColumn("at", at).withColumn("c", parse_hex(F.lit(color), (255, 0, 0)))
    return rows.select("doc_id", "page_index", "at.x", "at.y", F.lit(text).alias("text"), F.lit(font_size).alias("font_size"), F.lit(angle).alias("angle"), F.lit(opacity).alias("opacity"), "c.r", "c.g", "c.b")


def image_watermark(pages: DataFrame, image_w: float, image_h: float, only: DataFrame | None = None, *, opacity: float = 0.3) -> DataFrame:
    """A row per page: the image's box, centred, neither side over half the page's."""
    w, h = F.least(F.lit(image_w), F.col("width") * 0.5), F.least(F.lit(image_h), F.col("height") * 0.5)
    return _target_pages(pages, only).select(
        "doc_id", "page_index", ((F.col("width") - w) / 2).alias("x"), ((F.col("height") - h) / 2).alias("y"), w.alias("width"), h.alias("height"), F.lit(opacity).alias("opacity")
    )
