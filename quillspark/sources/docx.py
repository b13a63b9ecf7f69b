"""DOCX files to runs and table cells, and runs to DOCX bytes. One file is one row at either end."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the format.
W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WP = "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"
RELATIONSHIPS = "http://schemas.openxmlformats.org/package/2006/relationships"
RUNS = (
    "path string, block int, para_seq int, run_seq int, style string, text string, bold boolean, italic boolean, underline boolean, font_size double, font_family string, color string, "
    "is_list boolean, list_level int, image_rel string, image_w double, image_h double, table_seq int, row int, col int, grid_span int, error string"
)
RELS_ROWS = "path string, rel_id string, target string, error string"
CONTENT_TYPES = (
    '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
    '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
)
RELS = (
    '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">'
    '<Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
)


def _q(tag: str) -> str:
    return f"{{{W}}}{tag}"


def _on(props: ET.Element | None, tag: str) -> bool:
    found = props.find(_q(tag)) if props is not None else None
    return found is not None and found.get(_q("val"), "true") not in ("0", "false", "none")


def _attr(parent: ET.Element | None, tag: str, name: str = "val") -> str | None:
    found = parent.find(_q(tag)) if parent is not None else None
    return found.get(_q(name)) if found is not None else None


def _picture(run: ET.Element) -> dict:
    """Relationship and size in points of a run's picture."""
    blip, extent = run.find(f".//{{{A}}}blip"), run.find(f".//{{{WP}}}extent")
    if blip is None:
        return {}
    points = lambda name: int(extent.get(name, "0")) * 72 / 914400 if extent is not None else None
    return {"image_rel": blip.get(f"{{{R}}}embed"), "image_w": points("cx"), "image_h": points("cy")}


def parse_docx(data: bytes) -> Iterator[dict]:
    """A row per run, in order; runs in tables carry table, row and column. A run without text or picture is left out; a paragraph
    without runs has a row without a run number. ``block`` counts paragraphs and tables of the body.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(_q("body"))
    seq = at = 0

    def paragraph(p: ET.Element, cell: dict) -> Iterator[dict]:
        nonlocal seq
        props = p.find(_q("pPr"))
        num = props.find(_q("numPr")) if props is not None else None
        listed = num is not None and int(_attr(num, "numId") or 0) > 0
        shared = {
            "block": at, "para_seq": seq, "style": _attr(props, "pStyle"), "is_list": listed, "list_level": int(_attr(num, "ilvl") or 0) if listed else None, **cell,
        }
        seen = False
        for i, r in enumerate(p.iter(_q("r"))):
            seen = True
            rp = r.find(_q("rPr"))
            size, line = _attr(rp, "sz"), _attr(rp, "u")
            text = "".join(t.text or "" if t.tag == _q("t") else "\n" if t.tag == _q("br") else "\t" if t.tag == _q("tab") else "" for t in r)
            picture = _picture(r)
            if text or picture:
                yield {
                    "run_seq": i, "text": text, "bold": _on(rp, "b"), "italic": _on(rp, "i"), "underline": line not in (None, "none"), "font_size": float(size) / 2 if size else None,
                    "font_family": _attr(rp, "rFonts", "ascii"), "color": _attr(rp, "color"), **picture, **shared,
                }
        if not seen:
            yield shared
        seq += 1

    tables = 0
    for block in body if body is not None else ():
        if block.tag == _q("p"):
            yield from paragraph(block, {})
        elif block.tag == _q("tbl"):
            for i, row in enumerate(block.iter(_q("tr"))):
                for j, tc in enumerate(row.iter(_q("tc"))):
                    span = tc.find(f"{_q('tcPr')}/{_q('gridSpan')}")
                    for p in tc.iter(_q("p")):
                        yield from paragraph(p, {"table_seq": tables, "row": i, "col": j, "grid_span": int(span.get(_q("val"), "1")) if span is not None else 1})
            tables += 1
        else:
            continue
        at += 1


def parse_rels(data: bytes) -> Iterator[dict]:
    """A row per relationship of the document part; none where the package has no such part."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "word/_rels/document.xml.rels" in z.namelist():
            for r in ET.fromstring(z.read("word/_rels/document.xml.rels")).iter(f"{{{RELATIONSHIPS}}}Relationship"):
                if r.get("Id") and r.get("Target"):
                    yield {"rel_id": r.get("Id"), "target": r.get("Target")}


def _rows_of(files: DataFrame, columns: str, parse) -> DataFrame:
    """Rows that ``parse`` finds in each of ``files`` (path, content); a file that cannot be read gives a row with ``error``."""
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split() for c in columns.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    rows = [{"path": path, **r} for r in parse(data.as_py())]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, TypeError, ValueError) as e:
                    rows = [{"path": path, "error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.select("path", "content").mapInArrow(run, columns)


def parse_files(files: DataFrame) -> DataFrame:
    """Runs of ``files`` (path, content). A file that cannot be read gives a row with ``error``."""
    return _rows_of(files, RUNS, parse_docx)


def parse_relationships(files: DataFrame) -> DataFrame:
    """path, rel_id, target, error of ``files`` (path, content)."""
    return _rows_of(files, RELS_ROWS, parse_rels)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return parse_files(spark.read.format("binaryFile").load(path))


def pack_docx(xml: DataFrame) -> DataFrame:
    """doc_id, content: a file for each row of ``xml`` (doc_id, body: the XML of the document's body, and rels: ARRAY<STRUCT<id, target>>, if
    there are relationships)."""
    rels = F.col("rels") if "rels" in xml.columns else F.lit(None).cast("array<struct<id:string,target:string>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for body, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                parts = [("[Content_Types].xml", CONTENT_TYPES), ("_rels/.rels", RELS), ("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W}"><w:body>{body or ""}</w:body></w:document>')]
                if found:
                    root = ET.Element("Relationships", xmlns=RELATIONSHIPS)
                    for r in found:
                        ET.SubElement(root, "Relationship", Id=r["id"], Type=f"{R}/image", Target=r["target"])
                    parts.append(("word/_rels/document.xml.rels", ET.tostring(root, encoding="unicode")))
                buf = io.BytesIO()
                with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
                    for name, text in parts:
                        z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
                out.append(buf.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["doc_id", "content"])

    return xml.select(F.col("doc_id").cast("bigint").alias("doc_id"), "body", rels.alias("rels")).mapInArrow(run, "doc_id bigint, content binary")
