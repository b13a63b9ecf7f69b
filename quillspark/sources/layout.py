"""A deterministic page layout for plain text: fixed advance, lines as given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_W, PAGE_H, MARGIN, ADVANCE, PITCH, HEIGHT = 595.0, 842.0, 40.0, 6.0, 12.0, 10.0
LINES = 63
BLOCK, BLOCK_GAP = 7, 6.0


def spread(rows: DataFrame, least: int = 2) -> DataFrame:
    """``rows`` dealt anew where the source has too few splits (under ``least`` for each core) for work that is heavy in each row.

    Large sources have splits enough and stay as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= least * cores else rows.repartition(least * cores)


def deal(rows: DataFrame) -> DataFrame:
    """``rows`` over all shuffle partitions: adaptive execution joins small ones, which is wrong where little data is much work."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, page_index, line, text: a row per line of each document; null texts have none."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("l", "text"))
    return rows.select("doc_id", F.floor(F.col("l") / LINES).cast("int").alias("page_index"), (F.col("l") % LINES).alias("line"), "text")


def pages(docs: DataFrame) -> DataFrame:
    """doc_id, page_index, width, height, rotation."""
    n = F.ceil(F.size(F.split("text", "\n")) / LINES).cast("int")
    rows = docs.where("text IS NOT NULL").select("doc_id", F.explode(F.sequence(F.lit(0), n - 1)).alias("page_index"))
    return rows.select("doc_id", "page_index", F.lit(PAGE_W).alias("width"), F.lit(PAGE_H).alias("height"), F.lit(0).alias("rotation"))


def page_glyphs(docs: DataFrame) -> DataFrame:
    """doc_id, page_index, glyphs (seq, ch, x, y: baseline from the top, width, height, font_size, font_name): a row per page.

    Lines come in blocks of ``BLOCK``, parted by ``BLOCK_GAP``; the font size hangs on the block and the line, so that
    there are paragraphs, and headings of two levels among them.
    """

    def line(text: Column, n: Column) -> Column:
        block = F.floor(n / BLOCK)
        size = F.when(block % 3 == 0, 20.0).when(block % 3 == 1, 15.5).otherwise(HEIGHT) + F.when(n % 2 == 0, -1.0).otherwise(0.0)
        y = MARGIN + PITCH * n + BLOCK_GAP * block + HEIGHT
        font = F.when(block % 3 == 0, "Courier-Bold").otherwise("Courier")
        chars = F.filter(F.split(text, ""), lambda c: c != "")
        return F.transform(chars, lambda c, k: F.struct(
            (n.cast("long") * 10_000_000 + k).alias("seq"), c.alias("ch"), (MARGIN + ADVANCE * k).alias("x"), y.alias("y"),
            F.lit(ADVANCE).alias("width"), F.lit(HEIGHT).alias("height"), size.alias("font_size"), font.alias("font_name"),
        ))

    paged = docs.where("text IS NOT NULL").select("doc_id", F.split("text", "\n").alias("ls"))
    paged = paged.select("doc_id", "ls", F.explode(F.sequence(F.lit(0), F.ceil(F.size("ls") / LINES).cast("int") - 1)).alias("page_index"))
    return paged.select("doc_id", "page_index", F.flatten(F.transform(F.slice("ls", F.col("page_index") * LINES + 1, LINES), line)).alias("glyphs"))


def glyphs(docs: DataFrame) -> DataFrame:
    """:func:`page_glyphs` with a row per character."""
    return page_glyphs(docs).select("doc_id", "page_index", F.explode("glyphs").alias("g")).select("doc_id", "page_index", "g.*")
