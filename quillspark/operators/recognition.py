"""A place for a text recogniser: pages of images in, blocks out. None is built in."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "doc_id bigint, page_index int, block_seq int, text string, x double, y double, width double, height double, confidence double, mode string, error string"

#: Takes an image and a language; gives (text, x, y, width, height, confidence), boxes from 0 to 1.
Engine = Callable[[bytes, str], Iterable[tuple[str, float, float, float, float, float]]]


def recognize(images: DataFrame, make_engine: Callable[[], Engine], language: str = "en") -> DataFrame:
    """Blocks of ``images`` (doc_id, page_index, image), with mode ``ocr``, in the engine's order.

    ``make_engine`` runs once a task. An image that the engine fails on gives a row with ``error``; a null image gives none.
    """
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in BLOCKS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = make_engine()
        for batch in batches:
            for doc_id, page, image in zip(*batch.columns, strict=True):
                at = {"doc_id": doc_id.as_py(), "page_index": page.as_py(), "mode": "ocr"}
                try:
                    rows = [at | {"block_seq": i, **dict(zip(("text", "x", "y", "width", "height", "confidence"), r, strict=True))} for i, r in enumerate(engine(image.as_py(), language))]
                except Exception as e:  # noqa: BLE001 - an engine may fail on an image in any way
                    rows = [at | {"error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    asked = images.where("image IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page_index").cast("int").alias("page_index"), "image")
    return asked.mapInArrow(run, BLOCKS)
