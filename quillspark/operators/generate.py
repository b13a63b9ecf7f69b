"""Documents from a template and data, as drawn boxes.

A template is a small definition, known when the plan is made: its elements become expressions over a JSON column, so one
projection lays out every document of a table. A document's row goes through three steps:

1. bind: placeholders become key lookups; a table's cells are bound once more, as their values may be templates;
2. measure: every element becomes flow items, each with its boxes relative to its own top;
3. paginate: a fold over the items breaks pages; a table's header comes again on each page.

Text is measured with a fixed advance, ``ADVANCE`` times the font size a character.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from math import floor
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.strings import let
from quillspark.functions.templates import PLACEHOLDER, bind, key_path
from quillspark.operators.templates import wrap

ADVANCE = 0.6
LINE = 1.2
PADDING = 6.0
CELL = 4.0
SPACING = 4.0
DRAWN_INSIDE = ("text", "image", "line", "spacer", "rect")

BOX = "struct<kind:string,x:double,y:double,width:double,height:double,text:string,font_size:double,bold:boolean,italic:boolean,color:string,drawn:boolean>"
BOXES = f"array<{BOX}>"
ITEM = f"struct<need:double,advance:double,head_h:double,boxes:{BOXES},head:{BOXES}>"
ITEMS = f"array<{ITEM}>"
PLACES = "array<struct<page:int,top:double,again:boolean>>"
MADE = f"struct<boxes:{BOXES},height:double>"
#: An item that never asks for room.
ANY_ROOM = -1e12


@dataclass(frozen=True)
class Font:
    size: float
    bold: bool
    italic: bool
    color: str


@dataclass(frozen=True)
class Frame:
    """Where an element goes: left edge, width, default font, and the column with the data."""

    x: float
    width: float
    font: dict
    data: Column


def _font(frame: Frame, own: dict | None, **default: Any) -> Font:
    """An element's font: what it says itself, then ``default``, then the template's, then 12 points in black."""
    own = {k: v for k, v in (own or {}).items() if v is not None}
    merged = {"size": 12.0, "bold": False, "italic": False, "color": "#000000"} | frame.font | default | own
    return Font(float(merged["size"] or 12.0), bool(merged["bold"]), bool(merged["italic"]), merged["color"] or "#000000")


def _d(value: Any) -> Column:
    return value.cast("double") if isinstance(value, Column) else F.lit(float(value))


def _box(kind: str, x: Any, y: Any, w: Any, h: Any, text: Column | str | None = None, font: Font | None = None, color: str | None = None, drawn: bool = True) -> Column:
    said = text if isinstance(text, Column) else F.lit(text).cast("string")
    flag = lambda v: F.lit(v).cast("boolean")
    return F.struct(
        F.lit(kind).alias("kind"), _d(x).alias("x"), _d(y).alias("y"), _d(w).alias("width"), _d(h).alias("height"), said.alias("text"),
        F.lit(font.size if font else None).cast("double").alias("font_size"), flag(font.bold if font else None).alias("bold"), flag(font.italic if font else None).alias("italic"),
        F.lit(font.color if font else color).cast("string").alias("color"), flag(drawn).alias("drawn"),
    ).cast(BOX)


def _boxes(*found: Column) -> Column:
    return F.array(*found).cast(BOXES)


def _all(parts: list[Column], kind: str) -> Column:
    return F.concat(*parts) if parts else F.array().cast(kind)


def _item(need: Any, advance: Any, boxes: Column, head_h: float = 0.0, head: Column | None = None) -> Column:
    return F.struct(_d(need).alias("need"), _d(advance).alias("advance"), _d(head_h).alias("head_h"), boxes.alias("boxes"), (head if head is not None else _boxes()).alias("head")).cast(ITEM)


def _made(boxes: Column, height: Any) -> Column:
    """What an element draws and how high it is, as one value, so that neither is worked out twice."""
    return F.struct(boxes.alias("boxes"), _d(height).alias("height")).cast(MADE)


def bound(template: str, data: Column) -> Column:
    """A template text with its placeholders looked up in ``data``."""
    parts, at = [], 0
    for m in re.finditer(PLACEHOLDER, template):
        parts += [F.lit(template[at : m.start()]), key_path(data, m[1])]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def _aligned(el: dict, frame: Frame, width: Any, pad: float = 0.0, x: float | None = None, whole: float | None = None) -> Column:
    x, whole = frame.x if x is None else x, frame.width if whole is None else whole
    side = el.get("alignment", "left")
    if side == "center":
        return _d(x) + (_d(whole) - _d(width)) / 2
    return _d(x) + _d(whole) - _d(width) - pad if side == "right" else _d(x) + pad


def _shift(boxes: Column, y: Column) -> Column:
    names = [f.split(":")[0] for f in BOX.removeprefix("struct<").removesuffix(">").split(",")]
    return F.transform(boxes, lambda b: F.struct(*((b[n] + y if n == "y" else b[n]).alias(n) for n in names)))


def _margin(el: dict) -> float:
    return float(el.get("marginBottom") or 0.0)


def _text(el: dict, frame: Frame) -> Column:
    """A text; one that is empty draws nothing and has no height."""
    font = _font(frame, el.get("font"))
    limit = floor(float(el.get("maxWidth") or frame.width) / (ADVANCE * font.size) + 1e-9)

    def lay(text: Column) -> Column:
        def lines(ls: Column) -> Column:
            def line(t: Column, i: Column) -> Column:
                w = F.length(t) * (ADVANCE * font.size)
                return _box("text", _aligned(el, frame, w), i * (LINE * font.size), w, font.size, t, font)

            return _made(F.transform(ls, line).cast(BOXES), F.size(ls) * (LINE * font.size) + _margin(el))

        return F.when(text == "", _made(_boxes(), 0.0)).otherwise(let(wrap(text, limit), lines))

    return let(bound(el["content"], frame.data), lay)


def _simple(el: dict, frame: Frame) -> Column:
    """An element that is never divided."""
    kind = el["type"]
    if kind == "text":
        return _text(el, frame)
    if kind == "image":
        w, h = float(el["width"]), float(el["height"])
        draw = lambda src: F.when(src == "", _made(_boxes(), 0.0)).otherwise(_made(_boxes(_box("image", _aligned(el, frame, w), 0, w, h, src)), h + _margin(el)))
        return let(bound(el["src"], frame.data), draw)
    if kind == "line":
        thick = float(el.get("thickness", 1.0))
        return _made(_boxes(_box("line", frame.x, 0, frame.width, thick, color=el.get("color", "#CCCCCC"))), thick + _margin(el))
    if kind == "spacer":
        return _made(_boxes(), el["height"])
    if kind == "rect":
        w, h = float(el["width"]), float(el["height"])
        drawn = [_box("fill", frame.x, 0, w, h, color=el["fillColor"])] if el.get("fillColor") else []
        drawn += [_box("border", frame.x, 0, w, h, color=el["borderColor"])] if el.get("borderColor") else []
        return _made(_boxes(*drawn), h + _margin(el))
    if kind == "columns":
        return _columns(el, frame)
    if kind == "table":
        head, row = _row_heights(el, frame)
        return _made(_boxes(), F.coalesce(F.size(_rows(el, frame)), F.lit(0)) * row + (head + _margin(el)))
    if kind == "keyValue":
        line = _font(frame, el.get("labelFont")).size * LINE + SPACING
        return _made(_boxes(), line * len(el["entries"]) + _margin(el))
    return _made(_boxes(), 0.0)


def _stack(elements: list[dict], frame: Frame) -> Column:
    """Elements below each other. Only plain ones are drawn; others take their room and are marked."""
    if not elements:
        return _made(_boxes(), 0.0)

    def pile(parts: Column) -> Column:
        boxes, height = [], F.lit(0.0)
        for i, el in enumerate(elements):
            part = F.get(parts, i)
            own = part["boxes"]
            if el["type"] not in DRAWN_INSIDE:
                own = F.when(part["height"] > 0, _boxes(_box(el["type"], frame.x, 0, frame.width, part["height"], drawn=False))).otherwise(_boxes())
            boxes.append(_shift(own, height))
            height = height + part["height"]
        return _made(_all(boxes, BOXES), height)

    return let(F.array(*(_simple(el, frame) for el in elements)), pile)


def _columns(el: dict, frame: Frame) -> Column:
    cols, gap = el["columns"], float(el.get("gap", 10.0))
    weight = sum(float(c["width"]) for c in cols)
    room = frame.width - gap * max(0, len(cols) - 1)
    x, inside = frame.x, []
    for c in cols:
        width = room * float(c["width"]) / weight
        inside.append(_stack(c.get("elements") or [], Frame(x, width, frame.font, frame.data)))
        x += width + gap
    if not inside:
        return _made(_boxes(), _margin(el))
    side_by_side = lambda parts: _made(F.flatten(F.transform(parts, lambda p: p["boxes"])), F.array_max(F.transform(parts, lambda p: p["height"])) + _margin(el))
    return let(F.array(*inside), side_by_side)


def _row_heights(el: dict, frame: Frame) -> tuple[float, float]:
    head = _font(frame, el.get("headerFont"), bold=True).size * LINE + 2 * PADDING
    return head, float(el.get("rowHeight") or _font(frame, el.get("bodyFont")).size * LINE + 2 * PADDING)


def _rows(el: dict, frame: Frame) -> Column:
    """The table's rows: the array at its key, a struct of texts each; null where there is none."""
    keys = dict.fromkeys(c["key"] for c in el["columns"])
    schema = "array<struct<" + ",".join(f"`{k}`:string" for k in keys) + ">>"
    return F.filter(F.from_json(F.get_json_object(frame.data, "$." + el["dataKey"]), schema), lambda r: r.isNotNull())


def _table(el: dict, frame: Frame) -> Column:
    """A header and a row an item; a row that begins a page has the header again before it."""
    cols = el["columns"]
    weight = sum(float(c["width"]) for c in cols)
    widths = [frame.width * float(c["width"]) / weight for c in cols]
    lefts = [frame.x + sum(widths[:i]) for i in range(len(cols))]
    head_font, font = _font(frame, el.get("headerFont"), bold=True), _font(frame, el.get("bodyFont"))
    head_h, row_h = _row_heights(el, frame)
    grid = [_box("grid", frame.x, head_h, frame.width, 0.5, color=el.get("gridLineColor", "#CCCCCC"))] if el.get("showGridLines", True) else []
    head = [_box("head", frame.x, 0, frame.width, head_h, color="#F0F0F0")]
    for c, x, w in zip(cols, lefts, widths, strict=True):
        text_w = len(c["header"]) * ADVANCE * head_font.size
        head.append(_box("text", _aligned(c, frame, text_w, CELL if c.get("alignment") != "center" else 0.0, x, w), head_h - PADDING - head_font.size, text_w, head_font.size, c["header"], head_font))
    head_boxes = _boxes(*head, *grid)

    def row(r: Column, i: Column) -> Column:
        cells = []
        for c, x, w in zip(cols, lefts, widths, strict=True):
            value = F.coalesce(r[c["key"]], F.lit(""))
            value = F.when(F.contains(value, F.lit("{{")), bind(value, lambda k: F.call_function("get_json_object", frame.data, F.concat(F.lit("$."), k)))).otherwise(value)
            text_w = F.length(value) * (ADVANCE * font.size)
            pad = CELL if c.get("alignment") != "center" else 0.0
            cells.append(_box("cell", _aligned(c, frame, text_w, pad, x, w), row_h - PADDING - font.size, text_w, font.size, value, font))
        stripe = F.when(i % 2 == 1, _boxes(_box("stripe", frame.x, 0, frame.width, row_h, color=el.get("stripeColor")))).otherwise(_boxes()) if el.get("stripeColor") else _boxes()
        line = _boxes(_box("grid", frame.x, row_h, frame.width, 0.5, color=el.get("gridLineColor", "#CCCCCC"))) if el.get("showGridLines", True) else _boxes()
        return _item(row_h, row_h, F.concat(stripe, _boxes(*cells), line), head_h, head_boxes)

    rows = F.coalesce(F.transform(_rows(el, frame), row).cast(ITEMS), F.array().cast(ITEMS))
    return F.concat(F.array(_item(head_h + row_h, head_h, head_boxes)), rows, F.array(_item(ANY_ROOM, _margin(el), _boxes())))


def _key_values(el: dict, frame: Frame) -> Column:
    label_font, font = _font(frame, el.get("labelFont"), bold=True), _font(frame, el.get("valueFont"))
    height = max(label_font.size, font.size) * LINE + SPACING
    items = []
    for e in el["entries"]:
        label, value = bound(e["label"], frame.data), bound(e["value"], frame.data)
        label_w = F.length(label) * (ADVANCE * label_font.size)
        both = _boxes(
            _box("text", frame.x, 0, label_w, label_font.size, label, label_font),
            _box("text", _d(frame.x) + label_w + float(el.get("gap", 8.0)), 0, F.length(value) * (ADVANCE * font.size), font.size, value, font),
        )
        items.append(_item(height, height, both))
    return F.array(*items, _item(ANY_ROOM, _margin(el), _boxes())).cast(ITEMS)


def _flow(elements: list[dict], frame: Frame) -> Column:
    """The items of a body. Elements of types that are not known are passed over."""
    parts = []
    for el in elements:
        if el.get("type") == "table":
            parts.append(_table(el, frame))
        elif el.get("type") == "keyValue":
            parts.append(_key_values(el, frame))
        elif el.get("type") in (*DRAWN_INSIDE, "columns"):
            # What is empty does not break a page, even where nothing is left of it.
            empties = el["type"] in ("text", "image")
            one = lambda m: F.array(_item(m["height"], m["height"], m["boxes"]))
            some = lambda m: F.when(m["height"] > 0, one(m)).otherwise(F.array().cast(ITEMS))
            parts.append(let(_simple(el, frame), some if empties else one))
    return _all(parts, ITEMS)


def _places(items: Column, top: Column, bottom: Column) -> Column:
    """Page and top of every item, and whether a header comes again before it."""
    start = F.struct(F.lit(0).alias("page"), top.alias("cursor"), F.array().cast(PLACES).alias("out"))

    def step(a: Column, x: Column) -> Column:
        over = a["cursor"] + x["need"] > bottom
        again = over & (x["head_h"] > 0)
        begin = F.when(over, top + x["head_h"]).otherwise(a["cursor"])
        place = F.struct((a["page"] + over.cast("int")).alias("page"), begin.alias("top"), again.alias("again"))
        return F.struct(place["page"].alias("page"), (begin + x["advance"]).alias("cursor"), F.concat(a["out"], F.array(place)).alias("out"))

    return F.aggregate(items, start, step, lambda a: a["out"])


def generate(template: dict, rows: DataFrame, keys: list[str], data_col: str = "data") -> DataFrame:
    """keys, page (from 0), part (header, body, footer, background), seq, and the box (kind, x, y from the top, width, height,
    text, font_size, bold, italic, color, drawn) of everything drawn.

    ``template``: pageSize, margins, defaultFont, backgroundColor, header, footer, body. ``rows``: keys and a JSON object in
    ``data_col``; a key that is missing or null is an empty text, or no rows. A document has one page at least. One
    document is one row while it is laid out.
    """
    size = template.get("pageSize") or {"width": 595.0, "height": 842.0}
    page_w, page_h = float(size["width"]), float(size["height"])
    margins = {"top": 40.0, "right": 40.0, "bottom": 40.0, "left": 40.0} | (template.get("margins") or {})
    frame = Frame(float(margins["left"]), page_w - float(margins["left"]) - float(margins["right"]), template.get("defaultFont") or {}, F.col("_data"))
    made = rows.select(*keys, F.col(data_col).alias("_data"))
    made = made.select(*keys, _flow(template.get("body") or [], frame).alias("_items"), _stack(template.get("header") or [], frame).alias("_header"), _stack(template.get("footer") or [], frame).alias("_footer"))
    top, bottom = F.lit(float(margins["top"])) + F.col("_header.height"), F.lit(page_h - float(margins["bottom"])) - F.col("_footer.height")
    made = made.select("*", top.alias("_top"), bottom.alias("_bottom"))
    made = made.withColumn("_places", _places(F.col("_items"), F.col("_top"), F.col("_bottom")))
    pages = F.coalesce(F.array_max(F.transform("_places", lambda p: p["page"])), F.lit(0))

    def seen(item: Column, place: Column) -> Column:
        """A list of (page, part, box) of an item and, where it comes again, of the header before it."""
        here = lambda boxes, y: F.transform(_shift(boxes, y), lambda b: F.struct(place["page"].alias("page"), F.lit("body").alias("part"), b.alias("b")))
        again = F.when(place["again"], here(item["head"], place["top"] - item["head_h"])).otherwise(F.array().cast(SEEN))
        return F.concat(again, here(item["boxes"], place["top"])).cast(SEEN)

    def on_each_page(p: Column) -> Column:
        part = lambda name, boxes, y: F.transform(_shift(boxes, y), lambda b: F.struct(p.alias("page"), F.lit(name).alias("part"), b.alias("b")))
        fill = [part("background", _boxes(_box("fill", 0, 0, page_w, page_h, color=template["backgroundColor"])), F.lit(0.0))] if template.get("backgroundColor") else []
        return F.concat(*fill, part("header", F.col("_header.boxes"), F.lit(float(margins["top"]))), part("footer", F.col("_footer.boxes"), F.col("_bottom"))).cast(SEEN)

    body = F.flatten(F.zip_with("_items", "_places", seen))
    around = F.flatten(F.transform(F.sequence(F.lit(0), pages), on_each_page))
    drawn = made.select(*keys, F.posexplode(F.concat(around, body)).alias("seq", "s"))
    return drawn.select(*keys, "s.page", "s.part", "seq", "s.b.*")


SEEN = f"array<struct<page:int,part:string,b:{BOX}>>"
