"""Document metadata from record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.dates import iso_second
from quillspark.operators.pages import metadata


def document_metadata(info: DataFrame, pages: DataFrame, fields: DataFrame) -> DataFrame:
    """doc_id, page_count, title, author, creation_date (UTC, as text), file_size, is_encrypted, is_signed.

    ``info``: doc_id, title, author, created, file_size, encrypted. ``fields``: doc_id, class, value; a document is signed if
    a signature field (class ``Sig``) has a value. Texts that are missing are empty, counts are 0.
    """
    signed = fields.where("class = 'Sig' AND value IS NOT NULL").select("doc_id", F.lit(True).alias("signed")).distinct()
    rows = info.join(metadata(pages), "doc_id", "left").join(signed, "doc_id", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return rows.select(
        "doc_id", F.coalesce("page_count", F.lit(0)).alias("page_count"), text("title"), text("author"), iso_second(F.col("created")).alias("creation_date"),
        F.coalesce("file_size", F.lit(0)).cast("bigint").alias("file_size"), F.coalesce("encrypted", F.lit(False)).alias("is_encrypted"), F.coalesce("signed", F.lit(False)).alias("is_signed"),
    )
