"""Bounded samples of labelled documents, for models that are fitted on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of the id as text, modulo 5, is 0. False for a null id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def labelled_ids(labels: DataFrame, label_col: str, most: int, where: Column | None = None) -> DataFrame:
    """doc_id, y for at most ``most`` ids of each label (0, 1), by hash of the id; conflicting labels count as 1."""
    y = labels.where(F.col(label_col).isin(0, 1) & F.col("doc_id").isNotNull())
    y = (y.where(where) if where is not None else y).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("y"))
    first = lambda v: y.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return first(0).unionAll(first(1))


def texts_of(docs: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """``ids`` with ``columns`` of their documents; the least row where an id is repeated. ``ids`` is small by its bound."""
    row = F.struct(*columns)
    found = docs.select("doc_id", *columns).join(F.broadcast(ids), "doc_id").groupBy(*ids.columns).agg(F.min(row).alias("r"))
    return found.select(*ids.columns, *(F.col(f"r.{c}").alias(c) for c in columns))
