"""What a viewer asks of pages, overlays and fields, as joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OVERLAY = "struct<id:string,pageIndex:int,x:double,y:double,width:double,height:double,selected:boolean,label:string>"
#: Powers of 8 that are 0 and infinite.
NOTHING, ALL = -999, 999


def nearest_page(viewports: DataFrame, extents: DataFrame) -> DataFrame:
    """view_id, page_index: of the pages that a viewport (view_id, doc_id, top, height) shows, the one whose middle is nearest to
    its own; the first on ties. ``extents``: doc_id, page_index, page_top, page_height. A viewport without a page has no row.
    """
    shown = (F.col("page_top") < F.col("top") + F.col("height")) & (F.col("page_top") + F.col("page_height") > F.col("top"))
    seen = _near(viewports, "top", "height", extents).where(shown)
    apart = F.abs(F.col("page_top") + F.col("page_height") / 2 - F.col("top") - F.col("height") / 2)
    return seen.groupBy("view_id").agg(F.min_by("page_index", F.struct(apart.alias("apart"), "page_index")).alias("page_index"))


def tap_to_page(taps: DataFrame, extents: DataFrame) -> DataFrame:
    """tap_id, page_index, x, y (0 to 1) of the first page that a tap (tap_id, doc_id, tap_x, tap_y) falls on. ``extents``: doc_id,
    page_index, page_top, page_width, page_height. A tap beside all pages has no row.
    """
    on = (F.col("tap_y") >= F.col("page_top")) & (F.col("tap_y") <= F.col("page_top") + F.col("page_height"))
    hit = _near(taps, "tap_y", None, extents).where(on)
    place = F.struct("page_index", (F.col("tap_x") / F.col("page_width")).alias("x"), ((F.col("tap_y") - F.col("page_top")) / F.col("page_height")).alias("y"))
    return hit.groupBy("tap_id").agg(F.min(place).alias("p")).select("tap_id", "p.page_index", "p.x", "p.y")


def _near(marks: DataFrame, at: str, height: str | None, extents: DataFrame) -> DataFrame:
    """Pairs of marks (doc_id, ``at``, ``height`` or none) and extents of a document, once each: all that meet, and few that don't.

    A document is cut into cells, whose height is the least power of 8 that both a mark and a page fit in. A mark is in the cell where
    it begins, a page in all cells where a mark that meets it can begin, two to four. Marks are written once for each power that pages have,
    and pages once for each that marks have.
    """
    top, bottom = F.col("page_top").cast("double"), (F.col("page_top") + F.col("page_height")).cast("double")
    # A page far from the top counts as higher than it is, so that cells' numbers stay exact.
    size = F.greatest(F.abs(F.col("page_height").cast("double")), F.abs(top) * 2.0**-40)
    pages = extents.where(bottom.isNotNull()).withColumn("page_power", _power(size))
    marks = marks.where(F.col(at).isNotNull() & (F.col(height).isNotNull() if height else F.lit(True)))
    marks = marks.withColumn("mark_power", _power(F.abs(F.col(height).cast("double"))) if height else F.lit(NOTHING))
    mark_powers, page_powers = (d.agg(F.collect_set(c).alias(c)) for d, c in ((marks, "mark_power"), (pages, "page_power")))

    def each(d: DataFrame, powers: DataFrame) -> DataFrame:
        c = powers.columns[0]
        return d.crossJoin(F.broadcast(powers)).withColumn(c, F.explode(c))

    reach = F.pow(F.lit(8.0), "mark_power")
    cell = F.greatest(F.pow(F.lit(8.0), "page_power"), reach, F.lit(1e-300))
    cells = F.sequence(F.floor((top - reach) / cell), F.floor(bottom / cell))
    pages = each(pages, mark_powers).withColumn("cell", F.explode(cells))
    marks = each(marks, page_powers).withColumn("cell", F.floor(F.col(at).cast("double") / cell))
    key = ["doc_id", "page_power", "mark_power", "cell"]
    return marks.join(pages, key).drop(*key[1:])


def _power(size: Column) -> Column:
    """The least k with ``size`` <= 8 ** k; NOTHING for 0, ALL for what is not finite."""
    k = F.ceil(F.log(8.0, F.least(size, F.lit(1e300)))).cast("int")
    return F.when(~(size < 1e300), ALL).when(size == 0, NOTHING).otherwise(F.when(F.pow(F.lit(8.0), k) < size, k + 1).otherwise(k))


def parse_overlays(texts: DataFrame) -> DataFrame:
    """doc_id, ord, overlay_id, page_index, x, y, width, height, selected, label from JSON arrays (doc_id, overlays).

    An entry without id, page or a number of its box is dropped, the others stay; a text that is no array has none.
    """
    rows = texts.select("doc_id", F.posexplode(F.from_json("overlays", f"array<{OVERLAY}>")).alias("ord", "o"))
    whole = " AND ".join(f"o.{c} IS NOT NULL" for c in ("id", "pageIndex", "x", "y", "width", "height"))
    return rows.where(whole).select(
        "doc_id", "ord", F.col("o.id").alias("overlay_id"), F.col("o.pageIndex").alias("page_index"), "o.x", "o.y", "o.width", "o.height",
        F.coalesce("o.selected", F.lit(False)).alias("selected"), F.coalesce("o.label", F.lit("")).alias("label"),
    )


def carry_over(new_fields: DataFrame, old_fields: DataFrame, typed: DataFrame) -> DataFrame:
    """doc_id, id, value of ``new_fields`` (doc_id, ord, id, value), with what was typed (doc_id, id, value) into the field that had the
    same place among ``old_fields`` (doc_id, ord, id); else their own value, or an empty one."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    now = new_fields.select("doc_id", place.alias("place"), "id", F.col("value").alias("own"))
    before = old_fields.select("doc_id", place.alias("place"), F.col("id").alias("old_id"))
    said = typed.select("doc_id", F.col("id").alias("old_id"), F.col("value").alias("typed"))
    rows = now.join(before, ["doc_id", "place"], "left").join(said, ["doc_id", "old_id"], "left")
    return rows.select("doc_id", "id", F.coalesce("typed", "own", F.lit("")).alias("value"))


def destination_pages(bookmarks: DataFrame, pages: DataFrame) -> DataFrame:
    """``bookmarks`` (doc_id, dest_ref, dest_number, ...) with page_index: the place of the page that dest_ref names (``pages``: doc_id,
    page_ref, page_index), else dest_number where it has no reference, else -1."""
    place = pages.select("doc_id", F.col("page_ref").alias("dest_ref"), F.col("page_index").alias("found"))
    index = F.when(F.col("dest_ref").isNotNull(), F.coalesce("found", F.lit(-1))).otherwise(F.coalesce("dest_number", F.lit(-1)))
    return bookmarks.join(place, ["doc_id", "dest_ref"], "left").withColumn("page_index", index.cast("int")).drop("found")


def positive_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes that can be drawn."""
    return boxes.where("width > 0")


def top_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of the readings of each place (keys, text, confidence, ord) the surest, the first on ties."""
    best = F.max_by(F.struct("text", "confidence"), F.struct("confidence", -F.col("ord"))).alias("b")
    return candidates.groupBy(*keys).agg(best).select(*keys, "b.text", "b.confidence")


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """Rows in an order that ``seed`` and their own values give, the same in every run."""
    return df.orderBy(F.xxhash64(F.lit(seed), *df.columns), *df.columns)
