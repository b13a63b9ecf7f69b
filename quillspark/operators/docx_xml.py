"""Paragraphs and runs as WordprocessingML, by expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.geometry import points_to_emu
from quillspark.functions.strings import style_flags, xml_escape


def run_xml(text: Column, font_size: Column, font_name: Column) -> Column:
    flags = style_flags(font_name)
    props = F.concat(F.when(flags["bold"], "<w:b/>").otherwise(""), F.when(flags["italic"], "<w:i/>").otherwise(""), F.lit('<w:sz w:val="'), (font_size * 2).cast("int").cast("string"), F.lit('"/>'))
    return F.concat(F.lit("<w:r><w:rPr>"), props, F.lit('</w:rPr><w:t xml:space="preserve">'), xml_escape(text), F.lit("</w:t></w:r>"))


def paragraph_xml(runs: Column, heading: Column) -> Column:
    style = F.when(heading > 0, F.concat(F.lit('<w:pPr><w:pStyle w:val="Heading'), heading.cast("string"), F.lit('"/></w:pPr>'))).otherwise("")
    return F.concat(F.lit("<w:p>"), style, runs, F.lit("</w:p>"))


def picture_xml(rel_id: Column, width: Column, height: Column, number: Column, share: float = 0.9) -> Column:
    """A paragraph with a picture of a size in points, at nine tenths of it."""
    size = lambda c: points_to_emu(c, share).cast("string")
    return F.concat(
        F.lit('<w:p><w:r><w:drawing><wp:inline xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"><wp:extent cx="'), size(width), F.lit('" cy="'), size(height),
        F.lit('"/><wp:docPr id="'), number.cast("string"), F.lit('" name="Image '), number.cast("string"),
        F.lit('"/><a:blip xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" r:embed="'), rel_id,
        F.lit('"/></wp:inline></w:drawing></w:r></w:p>'),
    )


def body_xml(runs: DataFrame) -> DataFrame:
    """doc_id, body from runs (doc_id, para_seq, run_seq, text, font_size, font_name)."""
    rows = runs.withColumn("xml", run_xml(F.col("text"), F.col("font_size"), F.col("font_name")))
    ordered = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "xml"))), lambda s: s["xml"]), "")
    size = F.avg("font_size")
    level = F.when(size > 18, 1).when(size > 15, 2).otherwise(0)
    paras = rows.groupBy("doc_id", "para_seq").agg(ordered("run_seq").alias("runs"), level.alias("level"))
    paras = paras.withColumn("xml", paragraph_xml(F.col("runs"), F.col("level")))
    return paras.groupBy("doc_id").agg(ordered("para_seq").alias("body"))
