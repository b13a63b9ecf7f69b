"""Form fields: read, fill, create."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.strings import appearance_font
from quillspark.operators.spatial import remove_in_regions


def form_fields(raw: DataFrame) -> DataFrame:
    """Fields from raw rows (doc_id, name, class, value, da, options)."""
    font = appearance_font(F.col("da"))
    kind = F.col("class")
    public = F.when(kind == "Tx", "text").when(kind == "Ch", "dropdown").when(kind == "Radio", "radio").when(kind == "Btn", "checkbox").otherwise("text")
    return raw.select("doc_id", F.col("name").alias("id"), "name", public.alias("type"), F.coalesce("value", F.lit("")).alias("value"), "options", font["font_size"].alias("font_size"), font["font_name"].alias("font_name"))


def last_values(values: DataFrame) -> DataFrame:
    """doc_id, id, value: the last (by ``ord``) of each field's values."""
    return values.groupBy("doc_id", "id").agg(F.max_by("value", "ord").alias("new_value"))


def fill(fields: DataFrame, values: DataFrame) -> DataFrame:
    """``fields`` with the values of ``values`` (doc_id, id, ord, value); values without a field are dropped.

    Checkboxes take ``true``, ``Yes`` and ``1`` as on.
    """
    on = F.col("new_value").isin("true", "Yes", "1")
    new = F.when(F.col("type") == "checkbox", F.when(on, "Yes").otherwise("Off")).otherwise(F.col("new_value"))
    joined = fields.join(last_values(values), ["doc_id", "id"], "left")
    return joined.withColumn("value", F.when(F.col("new_value").isNotNull(), new).otherwise(F.col("value"))).withColumn("filled", F.col("new_value").isNotNull()).drop("new_value")


def flatten(fields: DataFrame, boxes: DataFrame) -> DataFrame:
    """Field values as text blocks at their boxes (doc_id, id, page_index, x, y, width, height)."""
    return fields.where("value <> ''").join(boxes, ["doc_id", "id"]).select("doc_id", "page_index", "x", "y", "width", "height", F.col("value").alias("text"))


def create_fields(blocks: DataFrame, wanted: DataFrame, *, remove_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """(blocks, fields) after fields with boxes (doc_id, page_index, x, y, width, height, name, type) are put on pages."""
    kept = remove_in_regions(blocks, wanted) if remove_text else blocks
    size = F.greatest(F.lit(4.0), 0.75 * F.col("height"))
    return kept, wanted.select("doc_id", F.col("name").alias("id"), "name", "type", F.lit("").alias("value"), size.alias("font_size"))


def partition(fields: DataFrame) -> DataFrame:
    """``fields`` with ``section``: typed (texts, dropdowns), ticked (checkboxes, radio buttons), or null for others."""
    section = F.when(F.col("type").isin("text", "dropdown"), "typed").when(F.col("type").isin("checkbox", "radio"), "ticked")
    return fields.withColumn("section", section)
