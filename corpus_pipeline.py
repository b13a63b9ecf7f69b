"""A training corpus from ``documents``: five stages, each written as Parquet and reread by the next.

Every stage takes rows with the columns of ``documents`` (and any others, which are carried), in any number and order:
nulls, empty and very long texts, repeated rows, ties and empty tables have the result that the docstring of the stage's
operator states. A stage's intermediate tables go when the next stage begins, as its output is written by then.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm.decontaminate import drop_contaminated
from quillspark.llm.mixing import take_mix
from quillspark.llm.quality_classifier import good_documents
from quillspark.llm.sharding import shard_documents
from quillspark.llm.simhash_dedup import drop_near_copies
from quillspark.scratch import discard, materialize, remove, tables

_LEFT: dict[str, set[str]] = {}


def _after(earlier: str | None) -> Callable:
    """A stage that first removes what ``earlier`` left in the shared folder."""

    def wrap(stage: Callable) -> Callable:
        def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for path in _LEFT.pop(earlier, ()):
                remove(path)
            before = tables()
            out = stage(spark, docs, sf_dir)
            _LEFT[stage.__name__] = tables() - before
            return out

        run_stage.__name__, run_stage.__doc__ = stage.__name__, stage.__doc__
        return run_stage

    return wrap


@_after(None)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. Without labels of both kinds all stay; a document without text is judged by its metadata."""
    return good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_after("quality")
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one with the smallest id; texts without words are one group."""
    return drop_near_copies(docs)


@_after("near_dedup")
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Empty texts, and empty items, match nothing."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_after("decontaminate")
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it; a null source is a source, a text without words is taken once."""
    return take_mix(docs)


@_after("mixing")
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, with shard and slot; equal texts go to one shard where it has room."""
    return shard_documents(docs, carry=True)


STAGES = [
    ("quality classifier", quality),
    ("near-dedup", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: A trained classifier and hash-dealt places have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        then, docs = docs, materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        discard(then)
    for path in _LEFT.pop("sharding", ()):
        remove(path)
    return docs
