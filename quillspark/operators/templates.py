"""Template layout: binding is in functions.templates; here text is wrapped, elements measured and paginated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

LINE = 1.2


def wrap(text: Column, chars: Column | int) -> Column:
    """Lines of at most ``chars`` characters, words kept whole; a word that is longer has its own line; an empty paragraph is an empty line, one of spaces alone none."""
    limit = F.lit(chars) if isinstance(chars, int) else chars

    def paragraph(p: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("cur"), F.array().cast("array<string>").alias("done"))

        def step(a: Column, w: Column) -> Column:
            bare = F.coalesce(a["cur"], F.lit("")) == ""
            joined = F.when(bare, w).otherwise(F.concat(a["cur"], F.lit(" "), w))
            fits = bare | (F.length(joined) <= limit)
            return F.struct(F.when(fits, joined).otherwise(w).alias("cur"), F.when(fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))).alias("done"))

        def last(a: Column) -> Column:
            return F.when(a["cur"] == "", a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"])))

        return F.when(p == "", F.array(F.lit(""))).otherwise(F.aggregate(F.split(p, " "), start, step, last))

    return F.flatten(F.transform(F.split(text, "\n"), paragraph))


def text_height(lines: Column, size: Column | float, margin: Column | float = 0.0) -> Column:
    return F.when(lines > 0, lines * LINE * size + margin).otherwise(0.0)


def paginate(elements: DataFrame, keys: list[str], order: list[str], height: str, room: float, after: str | None = None) -> DataFrame:
    """``elements`` with page (from 0) and top: a page breaks before an element that does not fit under what is on it.

    One that is taller than a page breaks too. ``after``: space below an element, which never breaks a page itself. The running sum starts over at each break, so it is a fold over the
    ordered heights of a key, in one row.
    """
    item = F.struct(*order, F.col(height).alias("_h"), (F.col(after) if after else F.lit(0.0)).alias("_after"), F.struct(*[c for c in elements.columns if c not in keys]).alias("_row"))
    lists = elements.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("xs"))
    start = F.struct(F.lit(0).alias("page"), F.lit(0.0).alias("cursor"), F.array().cast("array<struct<page:int,top:double>>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        over = a["cursor"] + x["_h"] > room
        page, top = F.when(over, a["page"] + 1).otherwise(a["page"]), F.when(over, 0.0).otherwise(a["cursor"])
        return F.struct(page.alias("page"), (top + x["_h"] + x["_after"]).alias("cursor"), F.concat(a["out"], F.array(F.struct(page.alias("page"), top.alias("top")))).alias("out"))

    placed = lists.select(*keys, F.explode(F.arrays_zip("xs", F.aggregate("xs", start, step, lambda a: a["out"]).alias("at"))).alias("z"))
    return placed.select(*keys, "z.xs._row.*", "z.at.page", "z.at.top")


def table_pages(rows: DataFrame, keys: list[str], row_no: str, *, head: float, row: float, room: float, first_room: float) -> DataFrame:
    """``rows`` with page, place and striped: constant heights, the header repeated on each page, header and first row together."""
    on_first = F.greatest(F.lit(0), F.floor((F.lit(first_room) - head) / row))
    on_next = F.greatest(F.lit(1), F.floor((F.lit(room) - head) / row))
    i = F.col(row_no)
    late = i - on_first
    return rows.withColumn("page", F.when(i < on_first, 0).otherwise(F.floor(late / on_next) + 1).cast("int")).withColumn(
        "place", F.when(i < on_first, i).otherwise(late % on_next).cast("int")
    ).withColumn("striped", i % 2 == 1)


def column_boxes(columns: DataFrame, keys: list[str], order: list[str], weight: str, total: float, gap: float = 10.0) -> DataFrame:
    """``columns`` with width in proportion to ``weight`` (after gaps) and x, the running offset."""
    w = Window.partitionBy(*keys)
    room = F.lit(total) - gap * (F.count("*").over(w) - 1)
    sized = columns.withColumn("col_width", room * F.col(weight) / F.sum(weight).over(w))
    before = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return sized.withColumn("col_x", F.coalesce(F.sum(F.col("col_width") + gap).over(before), F.lit(0.0)))


def measure(elements: DataFrame, keys: list[str], gap: float = 8.0) -> DataFrame:
    """Height of each top-level element from the rows of its tree (element_id, parent_id, kind, own_height).

    A ``columns`` element is as high as its highest column, a column as high as its elements together.
    """
    leaf = elements.where("kind NOT IN ('columns', 'column')").groupBy(*keys, F.col("parent_id").alias("element_id")).agg(F.sum("own_height").alias("inner"))
    col = elements.where("kind = 'column'").join(leaf, [*keys, "element_id"], "left")
    tall = col.groupBy(*keys, F.col("parent_id").alias("element_id")).agg(F.max(F.coalesce("inner", F.lit(0.0))).alias("tallest"))
    return elements.where("parent_id IS NULL").join(tall, [*keys, "element_id"], "left").withColumn("height", F.when(F.col("kind") == "columns", F.coalesce("tallest", F.lit(0.0))).otherwise(F.col("own_height"))).drop("tallest")


def expand_sections(body: Column, sections: Column) -> Column:
    """``body`` with its element ``sections`` replaced by numbered headings and contents of ``sections`` (heading, content)."""
    numbered = F.flatten(F.transform(sections, lambda s, i: F.array(F.concat((i + 1).cast("string"), F.lit(". "), s["heading"]), s["content"])))
    return F.flatten(F.transform(body, lambda e: F.when(e == "sections", numbered).otherwise(F.array(e))))
