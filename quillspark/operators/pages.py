"""Page algebra over pages (doc_id, page_index, width, height, rotation)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.geometry import rotate


def metadata(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("page_count"))


def merge(pages: DataFrame, inputs: DataFrame) -> DataFrame:
    """Documents put after each other. ``inputs``: out_id, pos, doc_id; one that is named twice comes twice.

    A page's new index is its old one plus the pages of all inputs before, so page rows meet no window.
    """
    counts = metadata(pages)
    before = Window.partitionBy("out_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    offsets = inputs.join(counts, "doc_id").withColumn("offset", F.coalesce(F.sum("page_count").over(before), F.lit(0)))
    return pages.join(offsets, "doc_id").select(
        F.col("out_id").alias("doc_id"), (F.col("page_index") + F.col("offset")).cast("int").alias("page_index"), "width", "height", "rotation",
        F.col("doc_id").alias("from_doc"), F.col("page_index").alias("from_page"),
    )


def split(pages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Parts of documents. ``ranges``: doc_id, part, first, last (both included, cut at the end); they may overlap."""
    inside = (pages["page_index"] >= ranges["first"]) & (pages["page_index"] <= ranges["last"])
    return pages.join(ranges, (pages["doc_id"] == ranges["doc_id"]) & inside).select(
        pages["doc_id"], "part", (pages["page_index"] - F.greatest(ranges["first"], F.lit(0))).alias("page_index"), pages["page_index"].alias("from_page")
    )


def _renumber(pages: DataFrame, *order: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1
    return pages.withColumn("from_page", F.col("page_index")).withColumn("page_index", n)


def delete(pages: DataFrame, indexes: DataFrame, *, keep_one: bool = False) -> DataFrame:
    """Pages without those in ``indexes`` (doc_id, page_index), numbered anew; others in there are ignored.

    ``keep_one`` leaves a document as it is where no page would be left.
    """
    kept = pages.join(indexes.select("doc_id", "page_index").distinct(), ["doc_id", "page_index"], "left_anti")
    if keep_one:
        kept = kept.unionByName(pages.join(kept.select("doc_id").distinct(), "doc_id", "left_anti"))
    return _renumber(kept, "page_index")


def reorder(pages: DataFrame, orders: DataFrame) -> DataFrame:
    """``orders``: doc_id, order ARRAY<INT>, any list of pages; pages may be left out or come twice."""
    wanted = orders.select("doc_id", F.posexplode("order").alias("new_index", "page_index"))
    got = pages.join(wanted, ["doc_id", "page_index"])
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("new_index")) - 1
    return got.select("doc_id", n.alias("new"), F.col("page_index").alias("from_page"), "width", "height", "rotation").withColumnRenamed("new", "page_index")


def _per_document(df: DataFrame, item: Column, name: str) -> DataFrame:
    """doc_id and the document's items as an array in order, so that a join with pages makes no page twice."""
    return df.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias(name))


def _order(df: DataFrame, *otherwise: str) -> Column:
    return F.struct("ord", *otherwise) if "ord" in df.columns else F.struct(*otherwise)


def move(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """``moves``: doc_id, source, target (and ord): one page to another place, those between shift by one.

    Moves of one document are made after each other, by ord (else by source and target). Moves of or to a page that
    does not exist are passed over.
    """
    counts = metadata(pages)
    real = moves.join(counts, "doc_id").where("source BETWEEN 0 AND page_count - 1 AND target BETWEEN 0 AND page_count - 1")
    steps = _per_document(real, F.struct(_order(moves, "source", "target").alias("o"), "source", "target"), "steps")

    def step(p: Column, m: Column) -> Column:
        s, t = m["source"], m["target"]
        return F.when(p == s, t).when((s < t) & (p > s) & (p <= t), p - 1).when((s > t) & (p >= t) & (p < s), p + 1).otherwise(p)

    new = F.aggregate(F.coalesce("steps", F.array().cast(steps.schema["steps"].dataType)), F.col("page_index").cast("int"), lambda p, m: step(p, m).cast("int"))
    return pages.join(steps, "doc_id", "left").withColumn("from_page", F.col("page_index")).withColumn("page_index", new).drop("steps")


def rotate_pages(pages: DataFrame, turns: DataFrame) -> DataFrame:
    """``turns``: doc_id, page_index, degrees; those of one page add up. Width and height change places where the turn is a quarter."""
    whole = turns.groupBy("doc_id", "page_index").agg((F.sum("degrees") % 360).cast("int").alias("degrees"))
    d = F.coalesce(F.col("degrees"), F.lit(0))
    swap = d % 180 != 0
    return pages.join(whole, ["doc_id", "page_index"], "left").select(
        "doc_id", "page_index", F.when(swap, F.col("height")).otherwise(F.col("width")).alias("width"),
        F.when(swap, F.col("width")).otherwise(F.col("height")).alias("height"), rotate(F.col("rotation"), d).alias("rotation"),
    )


def insert(pages: DataFrame, new: DataFrame) -> DataFrame:
    """``new``: doc_id, page_index, width, height (and ord): a page to put before that index; later pages shift.

    Pages of one document are put in after each other, by ord (else by index), each into what is there by then.
    """
    item = F.struct(_order(new, "page_index", "width", "height").alias("o"), "page_index", "width", "height")
    steps = _per_document(new, item, "steps")
    shift = lambda xs, p: F.aggregate(xs, p.cast("int"), lambda q, x: F.when(q >= x["page_index"], q + 1).otherwise(q).cast("int"))
    none = F.array().cast(steps.schema["steps"].dataType)
    old = pages.join(steps, "doc_id", "left").withColumn("page_index", shift(F.coalesce("steps", none), F.col("page_index"))).drop("steps")
    later = F.when(F.col("i") + 1 < F.size("steps"), F.slice("steps", F.col("i") + 2, F.size("steps"))).otherwise(none)
    added = steps.select("doc_id", "steps", F.posexplode("steps").alias("i", "x"))
    added = added.select("doc_id", shift(later, F.col("x.page_index")).alias("page_index"), "x.width", "x.height", F.lit(0).alias("rotation"))
    return old.unionByName(added)


def page_changes(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Rows whose ``value`` differs from the row before of the same ``key``."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col(value))).drop("before")
