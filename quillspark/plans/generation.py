"""Named queries: documents from templates, DOCX files and viewer data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import dates, geometry, lookups, strings
from quillspark.functions.colors import parse_hex
from quillspark.functions.templates import key_path_list
from quillspark.operators import docx_layout, forms, generate, marks, metadata, spatial, templates, viewer
from quillspark.plans.catalog import LINES_SQL, PAGES_SQL, _fields, _pages, query, r6, table
from quillspark.sources import docx, layout

INVOICE = {
    "pageSize": {"width": 300, "height": 260},
    "margins": {"top": 20, "right": 20, "bottom": 20, "left": 20},
    "defaultFont": {"family": "Courier", "size": 10, "color": "#222222"},
    "header": [{"type": "text", "content": "{{client.name}}", "marginBottom": 4}],
    "footer": [{"type": "text", "content": "Thank you", "font": {"size": 8}, "alignment": "center"}],
    "body": [
        {"type": "text", "content": "Order {{number}}", "font": {"size": 18, "bold": True}, "marginBottom": 6},
        {"type": "line", "thickness": 2, "marginBottom": 4},
        {"type": "spacer", "height": 5},
        {"type": "rect", "width": 100, "height": 20, "fillColor": "#EEEEEE", "borderColor": "#000000", "marginBottom": 5},
        {"type": "columns", "marginBottom": 6, "columns": [
            {"width": 1, "elements": [{"type": "text", "content": "{{client.segment}}"}]},
            {"width": 2, "elements": [{"type": "text", "content": "{{date}}", "alignment": "right"}, {"type": "text", "content": "{{client.none}}"}, {"type": "text", "content": "{{priority}}"}]},
        ]},
        {"type": "image", "src": "{{logo}}", "width": 40, "height": 15},
        {"type": "table", "dataKey": "items", "rowHeight": 20, "headerFont": {"size": 9}, "stripeColor": "#F8F8F8", "marginBottom": 8, "columns": [
            {"header": "Part", "key": "part", "width": 2}, {"header": "No", "key": "number", "width": 1, "alignment": "center"}, {"header": "Qty", "key": "quantity", "width": 1, "alignment": "right"},
        ]},
        {"type": "keyValue", "entries": [{"label": "Status:", "value": "{{status}}"}, {"label": "Lines:", "value": "{{count}}"}]},
    ],
}


def _invoice_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """o_orderkey and a JSON object; the number in each item is a template of its own."""
    li = table(spark, sf_dir, "lineitem")
    item = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("ls"))
    each = F.transform("ls", lambda x: F.struct(F.concat(F.lit("Part "), x["l_partkey"].cast("string")).alias("part"), F.lit("{{number}}").alias("number"), x["l_quantity"].cast("int").alias("quantity")))
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(items, o["o_orderkey"] == items["l_orderkey"], "left")
    client = F.struct(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    data = F.to_json(F.struct(
        F.col("o_orderkey").alias("number"), client.alias("client"), dates.iso_date(F.col("o_orderdate")).alias("date"), F.col("o_orderpriority").alias("priority"),
        F.when(F.col("o_orderstatus") == "F", "logo.png").otherwise("").alias("logo"), F.col("o_orderstatus").alias("status"), F.coalesce(F.size("ls"), F.lit(0)).alias("count"), each.alias("items"),
    ))
    return rows.select("o_orderkey", data.alias("data"))


@query("""WITH li AS (SELECT l_orderkey, l_partkey, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS qty, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i FROM lineitem),
n AS (SELECT l_orderkey, count(*) AS n FROM li GROUP BY 1),
o AS (SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS num, c_name, c_mktsegment AS seg, strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority AS pri, o_orderstatus AS st, coalesce(n, 0) AS n,
  CASE WHEN o_orderstatus = 'F' THEN 1446e-1 ELSE 1296e-1 END AS t FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN n ON l_orderkey = o_orderkey),
p AS (SELECT *, t + 228e-1 AS c0, CAST(floor((2304e-1 - (t + 228e-1)) / 20) AS BIGINT) AS k FROM o),
e AS (SELECT *, CASE WHEN n <= k THEN 0 ELSE (n - k + 7) // 8 END AS last, CASE WHEN n <= k THEN c0 + 20 * n ELSE 588e-1 + 20 * ((n - k - 1) % 8 + 1) END + 8 AS c1 FROM p),
v AS (SELECT *, CASE WHEN c1 + 16 > 2304e-1 THEN last + 1 ELSE last END AS p1, CASE WHEN c1 + 16 > 2304e-1 THEN 36e0 ELSE c1 END AS y1 FROM e),
w AS (SELECT *, CASE WHEN y1 + 32 > 2304e-1 THEN p1 + 1 ELSE p1 END AS p2, CASE WHEN y1 + 32 > 2304e-1 THEN 36e0 ELSE y1 + 16 END AS y2 FROM v),
r AS (SELECT o_orderkey, num, l_partkey, qty, i, CASE WHEN i < k THEN 0 ELSE (i - k) // 8 + 1 END AS page, CASE WHEN i < k THEN c0 + 20 * i ELSE 588e-1 + 20 * ((i - k) % 8) END AS y FROM li JOIN p ON l_orderkey = o_orderkey),
h AS (SELECT o_orderkey, 0 AS page, t AS y FROM p UNION ALL SELECT o_orderkey, unnest(range(1, last + 1)), 36 FROM e WHERE last > 0),
g AS (SELECT o_orderkey, unnest(range(0, p2 + 1)) AS page, c_name FROM w),
b AS (
SELECT o_orderkey, page, 'header' AS part, 'text' AS kind, 20e0 AS x, 20e0 AS y, c_name AS text FROM g UNION ALL
SELECT o_orderkey, page, 'footer', 'text', 20 + (260 - 9 * 48e-1) / 2, 2304e-1, 'Thank you' FROM g UNION ALL
SELECT o_orderkey, 0, 'body', 'text', 20, 36, 'Order ' || num FROM w UNION ALL SELECT o_orderkey, 0, 'body', 'line', 20, 636e-1, NULL FROM w UNION ALL
SELECT o_orderkey, 0, 'body', unnest(['fill', 'border']), 20, 746e-1, NULL FROM w UNION ALL SELECT o_orderkey, 0, 'body', 'text', 20, 996e-1, seg FROM w UNION ALL
SELECT o_orderkey, 0, 'body', 'text', 280 - 60, 996e-1, day FROM w UNION ALL SELECT o_orderkey, 0, 'body', 'text', 30 + 250 / 3e0, 1116e-1, pri FROM w UNION ALL
SELECT o_orderkey, 0, 'body', 'image', 20, 1296e-1, 'logo.png' FROM w WHERE st = 'F' UNION ALL
SELECT o_orderkey, page, 'body', unnest(['head', 'text', 'text', 'text', 'grid']), unnest([20e0, 24e0, 150 + (65 - 108e-1) / 2, 280 - 162e-1 - 4, 20e0]), y + unnest([0, 78e-1, 78e-1, 78e-1, 228e-1]), unnest([NULL, 'Part', 'No', 'Qty', NULL]) FROM h UNION ALL
SELECT o_orderkey, page, 'body', unnest(['cell', 'cell', 'cell', 'grid']), unnest([24e0, 150 + (65 - 6 * length(num)) / 2, 280 - 6 * length(qty) - 4, 20e0]), y + unnest([4, 4, 4, 20]), unnest(['Part ' || CAST(l_partkey AS VARCHAR), num, qty, NULL]) FROM r UNION ALL
SELECT o_orderkey, page, 'body', 'stripe', 20, y, NULL FROM r WHERE i % 2 = 1 UNION ALL
SELECT o_orderkey, p1, 'body', 'text', unnest([20e0, 20 + 42 + 8]), y1, unnest(['Status:', st]) FROM w UNION ALL SELECT o_orderkey, p2, 'body', 'text', unnest([20e0, 20 + 36 + 8]), y2, unnest(['Lines:', CAST(n AS VARCHAR)]) FROM w)
SELECT o_orderkey, CAST(page AS INT) AS page, part, kind, round(CAST(x AS DOUBLE), 6) AS x, round(CAST(y AS DOUBLE), 6) AS y, text FROM b""")
def generate_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per order from a template with every kind of element, page breaks included."""
    boxes = generate.generate(INVOICE, layout.deal(_invoice_data(spark, sf_dir)), ["o_orderkey"])
    return boxes.select("o_orderkey", "page", "part", "kind", r6("x").alias("x"), r6("y").alias("y"), "text")


@query("""WITH li AS (SELECT l_orderkey, l_partkey, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS i FROM lineitem)
SELECT o_orderkey, CAST(i AS INT) AS row, unnest(['part', 'number', 'quantity', 'none']) AS key, unnest(['Part ' || CAST(l_partkey AS VARCHAR), '{{number}}', CAST(CAST(l_quantity AS INT) AS VARCHAR), '']) AS value FROM orders JOIN li ON l_orderkey = o_orderkey""")
def invoice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the invoices' tables by column key, straight from the JSON; a key that no row has is empty."""
    rows = _invoice_data(spark, sf_dir).select("o_orderkey", F.posexplode(F.from_json(F.get_json_object("data", "$.items"), "array<string>")).alias("row", "r"))
    keys = ("part", "number", "quantity", "none")
    cells = F.array(*(F.struct(F.lit(k).alias("key"), F.coalesce(F.get_json_object("r", f"$.{k}"), F.lit("")).alias("value")) for k in keys))
    return rows.select("o_orderkey", "row", F.explode(cells).alias("c")).select("o_orderkey", "row", "c.key", "c.value")


@query("""WITH n AS (SELECT l_orderkey, max(l_linenumber) AS pages, bool_or(l_returnflag = 'R') AS signed FROM lineitem GROUP BY 1)
SELECT o_orderkey AS doc_id, CAST(coalesce(pages, 0) AS INT) AS page_count, 'Order ' || CAST(o_orderkey AS VARCHAR) AS title, coalesce(c_name, '') AS author,
strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS creation_date, CAST(trunc(o_totalprice) AS BIGINT) AS file_size, o_orderstatus = 'P' AS is_encrypted, coalesce(signed, FALSE) AS is_signed
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN n ON l_orderkey = o_orderkey""")
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents: pages as many as their highest line number, signed where a line was returned."""
    o, c, li = (table(spark, sf_dir, t) for t in ("orders", "customer", "lineitem"))
    info = o.join(c, o["o_custkey"] == c["c_custkey"], "left").select(
        F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"), F.col("c_name").alias("author"), F.col("o_orderdate").alias("created"),
        F.floor("o_totalprice").alias("file_size"), (F.col("o_orderstatus") == "P").alias("encrypted"),
    )
    pages = li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.max("l_linenumber").alias("n")).select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("page_index"))
    fields = li.select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "R", "Sig").otherwise("Tx").alias("class"), F.col("l_linestatus").alias("value"))
    return metadata.document_metadata(info, pages, fields)


@query(f"""WITH p AS ({PAGES_SQL}), t AS (SELECT doc_id, page_index, 297.5 - 129.6 * cos(radians(30e0)) + 24 * sin(radians(30e0)) AS x, 421 - 129.6 * sin(radians(30e0)) - 24 * cos(radians(30e0)) AS y FROM p WHERE page_index < 2)
SELECT doc_id, CAST(page_index AS INT) AS page_index, 'text' AS kind, round(x, 6) AS x, round(y, 6) AS y, 3e-1 AS opacity FROM t UNION ALL
SELECT doc_id, CAST(page_index AS INT), 'image', round(CAST((595 - 297.5) / 2 AS DOUBLE), 6), round(CAST((842 - 100) / 2 AS DOUBLE), 6), 5e-1 FROM p""")
def watermark_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A turned text on the first two pages of each document, an image in the middle of all."""
    pages = _pages(spark, sf_dir)
    text = marks.text_watermark(pages, "WATERMARK", pages.where("page_index < 2"), angle=30.0)
    image = marks.image_watermark(pages, 400.0, 100.0, opacity=0.5)
    out = lambda df, kind: df.select("doc_id", "page_index", F.lit(kind).alias("kind"), r6("x").alias("x"), r6("y").alias("y"), "opacity")
    return out(text, "text").unionByName(out(image, "image"))


@query(f"""WITH {LINES_SQL.replace('SELECT doc_id, CAST(l // 63 AS INT) AS page_index, text FROM l', 'SELECT doc_id, CAST(l // 63 AS INT) AS page_index, 40e0 AS x, 842e0 - (50e0 + 12 * (l % 63)) AS y, text FROM l')},
f AS (SELECT item_id AS doc_id, 0 AS page_index, 30e0 AS x, 700e0 AS y, 200e0 AS width, 20e0 AS height FROM benchmark)
SELECT doc_id, 'line' AS kind, text AS name, CAST(NULL AS DOUBLE) AS font_size FROM nat WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = nat.doc_id AND f.page_index = nat.page_index
  AND nat.x >= f.x - 15 AND nat.x <= f.x + f.width + 15 AND nat.y >= f.y - 15 AND nat.y <= f.y + f.height + 15)
UNION ALL SELECT item_id, 'field', CASE WHEN trim(left(text, 30)) = '' THEN 'Field ' || CAST(item_id AS VARCHAR) ELSE trim(left(text, 30)) END, 15e0 FROM benchmark""")
def create_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field on the first page of documents that have a benchmark item's number, named by its text; lines under it go."""
    wanted = table(spark, sf_dir, "benchmark").select(
        F.col("item_id").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(30.0).alias("x"), F.lit(700.0).alias("y"), F.lit(200.0).alias("width"), F.lit(20.0).alias("height"),
        strings.default_field_name(F.col("text"), F.col("item_id")).alias("name"), F.lit("text").alias("type"),
    )
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("l", "text"))
    blocks = lines.select("doc_id", F.floor(F.col("l") / 63).cast("int").alias("page_index"), F.lit(40.0).alias("x"), (842.0 - (50.0 + 12 * (F.col("l") % 63))).alias("y"), "text")
    kept, fields = forms.create_fields(blocks, wanted)
    return kept.select("doc_id", F.lit("line").alias("kind"), F.col("text").alias("name"), F.lit(None).cast("double").alias("font_size")).unionByName(fields.select("doc_id", F.lit("field").alias("kind"), "name", "font_size"))


EXTENTS_SQL = "x AS (SELECT p_partkey % 100 AS doc_id, CAST(p_partkey // 100 AS INT) AS page_index, 50e0 * (p_partkey // 100) AS page_top, 10e0 + p_size % 40 AS page_height FROM part)"


def _extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of a hundred documents, below each other, with gaps."""
    k = F.col("p_partkey")
    place = F.floor(k / 100).cast("int")
    return table(spark, sf_dir, "part").select((k % 100).alias("doc_id"), place.alias("page_index"), (50.0 * place).alias("page_top"), F.lit(200.0).alias("page_width"), (10.0 + F.col("p_size") % 40).alias("page_height"))


@query(f"""WITH {EXTENTS_SQL}, v AS (SELECT event_id AS view_id, user_id % 100 AS doc_id, 7 * value AS top, 60e0 AS height FROM events),
s AS (SELECT view_id, page_index, abs(page_top + page_height / 2 - top - height / 2) AS apart FROM v JOIN x USING (doc_id) WHERE page_top < top + height AND page_top + page_height > top)
SELECT view_id, page_index FROM s QUALIFY row_number() OVER (PARTITION BY view_id ORDER BY apart, page_index) = 1""")
def nearest_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = table(spark, sf_dir, "events").select(F.col("event_id").alias("view_id"), (F.col("user_id") % 100).alias("doc_id"), (7 * F.col("value")).alias("top"), F.lit(60.0).alias("height"))
    return viewer.nearest_page(views, _extents(spark, sf_dir))


@query(f"""WITH {EXTENTS_SQL}, t AS (SELECT event_id AS tap_id, user_id % 100 AS doc_id, value AS tap_x, 7 * value AS tap_y FROM events)
SELECT tap_id, page_index, round(tap_x / 200, 6) AS x, round((tap_y - page_top) / page_height, 6) AS y FROM t JOIN x USING (doc_id) WHERE tap_y >= page_top AND tap_y <= page_top + page_height
QUALIFY row_number() OVER (PARTITION BY tap_id ORDER BY page_index) = 1""")
def tap_to_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    taps = table(spark, sf_dir, "events").select(F.col("event_id").alias("tap_id"), (F.col("user_id") % 100).alias("doc_id"), F.col("value").alias("tap_x"), (7 * F.col("value")).alias("tap_y"))
    # DuckDB rounds the millionfold double, Spark's round() the decimal that it prints as: they differ on halves.
    places = lambda c: (F.round(F.col(c) * 1e6) / 1e6).alias(c)
    return viewer.tap_to_page(taps, _extents(spark, sf_dir)).select("tap_id", "page_index", places("x"), places("y"))


@query("""SELECT p_partkey AS doc_id, CAST(0 AS INT) AS ord, 'o' || CAST(p_partkey AS VARCHAR) AS overlay_id, CAST(p_size % 7 AS INT) AS page_index, round(p_size / 100.0, 6) AS x, p_size % 2 = 0 AS selected, p_brand AS label FROM part WHERE p_partkey % 10 <> 3
UNION ALL SELECT p_partkey, 2, 'last', 1, 25e-2, FALSE, '' FROM part WHERE p_partkey % 10 <> 3""")
def overlays_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays of each part from JSON: the middle one lacks its page, every tenth text is broken."""
    overlay = F.struct(F.concat(F.lit("o"), F.col("p_partkey").cast("string")).alias("id"), (F.col("p_size") % 7).alias("pageIndex"), (F.col("p_size") / 100.0).alias("x"), F.lit(0.5).alias("y"), F.lit(0.1).alias("width"), F.lit(0.1).alias("height"), (F.col("p_size") % 2 == 0).alias("selected"), F.col("p_brand").alias("label"))
    rest = '{"id": "bad", "x": 1.0}, {"id": "last", "pageIndex": 1, "x": 0.25, "y": 0.5, "width": 1, "height": 1}'
    text = F.when(F.col("p_partkey") % 10 == 3, F.lit('{"id": ')).otherwise(F.concat(F.lit("["), F.to_json(overlay), F.lit(f", {rest}]")))
    return viewer.parse_overlays(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), text.alias("overlays"))).select("doc_id", "ord", "overlay_id", "page_index", r6("x").alias("x"), "selected", "label")


@query("""WITH n AS (SELECT c_custkey AS doc_id, unnest(['status', 'name', 'balance']) AS id, unnest([c_mktsegment, c_name, NULL]) AS own, unnest([1, 2, 3]) AS place FROM customer),
t AS (SELECT o_custkey AS doc_id, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)) AS s, arg_max(o_orderpriority, struct_pack(a := o_orderdate, b := o_orderkey)) AS p FROM orders GROUP BY 1)
SELECT doc_id, id, CASE WHEN place = 1 THEN coalesce(s, own) WHEN place = 2 THEN coalesce(p, own) ELSE coalesce(own, '') END AS value FROM n LEFT JOIN t USING (doc_id)""")
def carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's form is loaded anew with a field more; what was typed into the first two fields stays by place."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    field = lambda i, name, v: F.struct(F.lit(i).alias("ord"), F.lit(name).alias("id"), v.alias("value"))
    none = F.lit(None).cast("string")
    each = lambda *fs: c.select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(*fs)).alias("f")).select("doc_id", "f.*")
    new = each(field(5, "status", F.col("c_mktsegment")), field(6, "name", F.col("c_name")), field(7, "balance", none))
    old = each(field(1, "was first", none), field(2, "was second", none))
    last = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.max_by(F.struct("o_orderstatus", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey")).alias("l"))
    typed = last.select("doc_id", F.explode(F.array(F.struct(F.lit("was first").alias("id"), F.col("l.o_orderstatus").alias("value")), F.struct(F.lit("was second").alias("id"), F.col("l.o_orderpriority").alias("value")))).alias("t")).select("doc_id", "t.*")
    return viewer.carry_over(new, old, typed)


@query(f"""WITH p AS ({PAGES_SQL}), n AS (SELECT doc_id, count(*) AS n FROM p GROUP BY 1)
SELECT doc_id, unnest(['last', 'gone', 'number', 'nothing']) AS title, CAST(unnest([n - 1, -1, 3, -1]) AS INT) AS page_index FROM n""")
def destination_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks to a document's last page by its name, to a page that is gone, to a number, and to nothing."""
    pages = _pages(spark, sf_dir).select("doc_id", "page_index", F.concat(F.lit("p"), F.col("page_index").cast("string")).alias("page_ref"))
    n = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    mark = lambda title, ref, number: F.struct(F.lit(title).alias("title"), ref.cast("string").alias("dest_ref"), F.lit(number).cast("int").alias("dest_number"))
    marks_ = F.array(mark("last", F.concat(F.lit("p"), (F.col("n") - 1).cast("string")), 9), mark("gone", F.lit("p-1"), 9), mark("number", F.lit(None), 3), mark("nothing", F.lit(None), None))
    return viewer.destination_pages(n.select("doc_id", F.explode(marks_).alias("m")).select("doc_id", "m.*"), pages).select("doc_id", "title", "page_index")


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_quantity / 50 AS confidence, l_partkey AS ord, l_returnflag || l_linestatus AS text FROM lineitem)
SELECT l_orderkey, l_linenumber, round(max(confidence), 6) AS confidence, arg_max(text, struct_pack(a := confidence, b := -ord, c := text)) AS text FROM c GROUP BY 1, 2""")
def ocr_top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of one order and number as readings of one place."""
    c = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50).alias("confidence"), F.col("l_partkey").alias("ord"), F.concat("l_returnflag", "l_linestatus").alias("text"))
    first = c.groupBy("l_orderkey", "l_linenumber", "confidence", "ord").agg(F.max("text").alias("text"))
    return viewer.top_candidates(first, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", r6("confidence").alias("confidence"), "text")


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso, strftime(o_orderdate, '%B %-d, %Y') AS long, strftime(o_orderdate + to_days(CAST(o_orderkey % 45 AS INT)), '%Y-%m-%d') AS due,
strftime(o_orderdate + to_months(CAST(o_orderkey % 5 AS INT)), '%Y-%m-%d') AS later, strftime(o_orderdate - to_minutes(o_orderkey % 600), '%Y-%m-%dT%H:%M:%SZ') AS before FROM orders""")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", dates.iso_second(d).alias("iso"), dates.long_date(d).alias("long"), dates.iso_date(dates.shifted(d, days=(k % 45).cast("int"))).alias("due"),
        dates.iso_date(dates.shifted(d, months=(k % 5).cast("int"))).alias("later"), dates.iso_second(dates.shifted(d, minutes=(-(k % 600)).cast("int"))).alias("before"),
    )


@query("""WITH p AS (SELECT p_partkey, CAST(p_size AS INT) AS level, CASE p_partkey % 4 WHEN 0 THEN 'Letter' WHEN 1 THEN 'LEGAL' WHEN 2 THEN 'a4' ELSE NULL END AS size,
CASE p_partkey % 3 WHEN 0 THEN 'public.png' WHEN 1 THEN 'com.adobe.pdf' ELSE p_brand END AS kind FROM part)
SELECT p_partkey, CASE upper(size) WHEN 'LETTER' THEN 612e0 WHEN 'LEGAL' THEN 612e0 ELSE 595e0 END AS width, CASE upper(size) WHEN 'LETTER' THEN 792e0 WHEN 'LEGAL' THEN 1008e0 ELSE 842e0 END AS height,
CASE level WHEN 1 THEN 24e0 WHEN 2 THEN 20e0 WHEN 3 THEN 16e0 WHEN 4 THEN 14e0 WHEN 5 THEN 12e0 WHEN 6 THEN 11e0 ELSE 12e0 END AS heading, CASE kind WHEN 'public.png' THEN 'image/png' WHEN 'com.adobe.pdf' THEN 'application/pdf' ELSE kind END AS media FROM p""")
def lookups_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    size = F.when(k % 4 == 0, "Letter").when(k % 4 == 1, "LEGAL").when(k % 4 == 2, "a4")
    kind = F.when(k % 3 == 0, "public.png").when(k % 3 == 1, "com.adobe.pdf").otherwise(F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select("p_partkey", lookups.page_size(size).alias("s"), lookups.heading_size(F.col("p_size").cast("int")).alias("heading"), lookups.media_type(kind).alias("media"))
    return rows.select("p_partkey", "s.width", "s.height", "heading", "media")


@query("""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '#12' ELSE 'FF8000' END AS t FROM part)
SELECT p_partkey, k AS kind, CASE WHEN p_partkey % 2 = 1 THEN 255 WHEN k IN ('highlight', 'annotation', 'watermark') THEN 255 WHEN k = 'overlay' THEN NULL ELSE 0 END AS r,
CASE WHEN p_partkey % 2 = 1 THEN 128 WHEN k IN ('highlight', 'annotation') THEN 255 WHEN k = 'overlay' THEN NULL ELSE 0 END AS g, CASE WHEN k = 'overlay' AND p_partkey % 2 = 0 THEN NULL ELSE 0 END AS b
FROM (SELECT *, unnest(['highlight', 'annotation', 'template', 'edit', 'redaction', 'watermark', 'overlay']) AS k FROM t)""")
def color_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text as a colour of each thing that is coloured."""
    t = F.when(F.col("p_partkey") % 2 == 0, "#12").otherwise("FF8000")
    each = F.array(*(F.struct(F.lit(k).alias("kind"), parse_hex(t, other).alias("c")) for k, other in lookups.FALLBACK_COLORS.items()))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(each).alias("x")).select("p_partkey", "x.kind", "x.c.r", "x.c.g", "x.c.b")


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\p{L}\p{N}_]+(?:[''’.][\p{L}\p{N}_]+)*') AS w FROM documents)
SELECT doc_id, len(w) AS n_words, md5(array_to_string(w, ' ')) AS words_md5 FROM w WHERE w IS NOT NULL""")
def boundary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words between boundaries, as against words between spaces."""
    w = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", strings.boundary_words(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("bigint").alias("n_words"), F.md5(F.encode(F.array_join("w", " "), "UTF-8")).alias("words_md5"))


@query(r"""SELECT c_custkey, lower(c_mktsegment)[1:8] AS slug, 'INV-' || CASE WHEN length(CAST(c_custkey AS VARCHAR)) < 3 THEN lpad(CAST(c_custkey AS VARCHAR), 3, '0') ELSE CAST(c_custkey AS VARCHAR) END AS serial,
c_name || '.pdf' AS file, c_nationkey % 10 + 1 AS level, replace(c_mktsegment || ' é?', 'é', 'é') AS encoded, (c_mktsegment || ' ' || c_name)[1:CAST(floor((60 + c_nationkey - 8) / 5.0) AS BIGINT)] AS cell,
CASE WHEN c_nationkey % 3 = 0 THEN 'Times-Roman' WHEN c_nationkey % 3 = 1 THEN 'Courier' ELSE 'Helvetica' END AS font, c_nationkey % 3 = 0 AS bold, 'color: ' || c_mktsegment || ', #FFFFFF' AS style, round(c_acctbal, 2) AS money,
'/tmp/a b' || CAST(c_custkey AS VARCHAR) || '.pdf' AS path FROM customer""")
def string_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small string functions, one column each."""
    seg, name, nation = F.col("c_mktsegment"), F.col("c_name"), F.col("c_nationkey")
    font = F.when(nation % 3 == 0, "Times New Roman Bold").when(nation % 3 == 1, "COURIER").otherwise("Unknown")
    money = F.concat(F.lit("$"), F.format_number(F.floor(F.abs(F.round(F.col("c_acctbal") * 100)) / 100), 0), F.lit("."), F.lpad((F.abs(F.round(F.col("c_acctbal") * 100)) % 100).cast("int").cast("string"), 2, "0"))
    signed = F.when(F.col("c_acctbal") < 0, -1).otherwise(1) * strings.parse_money(money)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", strings.slug(F.concat(seg, F.lit(" 12-é"))).alias("slug"), strings.serial("INV-", F.col("c_custkey")).alias("serial"),
        strings.ensure_suffix(strings.ensure_suffix(F.when(nation % 2 == 0, F.concat(name, F.lit(".pdf"))).otherwise(name))).alias("file"),
        strings.heading_digits(F.concat(F.lit("Heading "), (nation % 10 + 1).cast("string"))).alias("level"), strings.winansi(F.concat(seg, F.lit(" é😀"))).alias("encoded"),
        strings.truncate_cell(F.concat(seg, F.lit("\n"), name), 60 + nation, 4.0, 10.0).alias("cell"), strings.font_alias(font).alias("font"), strings.style_flags(font)["bold"].alias("bold"),
        strings.substitute_tokens(F.lit("color: {{primary}}, {{paper}}"), {"primary": seg}, {"primary": "#000000", "paper": "#FFFFFF"}).alias("style"), F.round(signed, 2).alias("money"),
        strings.local_path(F.concat(F.lit("file:///tmp/a%20b"), F.col("c_custkey").cast("string"), F.lit(".pdf"))).alias("path"),
    )


def _docx_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file per benchmark item: a heading, its text in two runs, a list entry, an empty run, a picture, and a table with a wide cell."""
    run = lambda props, text: F.concat(F.lit(f"<w:r><w:rPr>{props}</w:rPr><w:t xml:space=\"preserve\">"), strings.xml_escape(text), F.lit("</w:t></w:r>"))
    para = lambda props, *runs: F.concat(F.lit(f"<w:p><w:pPr>{props}</w:pPr>"), *runs, F.lit("</w:p>"))
    cell = lambda text, span="": F.concat(F.lit(f"<w:tc><w:tcPr>{span}</w:tcPr><w:p><w:r><w:t>"), text, F.lit("</w:t></w:r></w:p></w:tc>"))
    row = lambda *cells: F.concat(F.lit("<w:tr>"), *cells, F.lit("</w:tr>"))
    number = F.col("item_id").cast("string")
    picture = f'<w:r><w:drawing><wp:inline xmlns:wp="{docx.WP}"><wp:extent cx="1828800" cy="914400"/><a:blip xmlns:a="{docx.A}" xmlns:r="{docx.R}" r:embed="rId7"/></wp:inline></w:drawing></w:r>'
    body = F.concat(
        para('<w:pStyle w:val="Heading2"/>', run("", F.concat(F.lit("Item "), number))),
        para("", run("<w:b/>", F.lit("Text: ")), run('<w:sz w:val="20"/>', F.replace(F.col("text"), F.lit("\n"), F.lit(" "))), F.lit("<w:r></w:r>")),
        para('<w:numPr><w:ilvl w:val="1"/><w:numId w:val="3"/></w:numPr>', run("", F.lit("an entry"))),
        para("", F.lit(picture)), F.lit("<w:p/>"),
        F.lit("<w:tbl>"), row(cell(F.lit("wide"), '<w:gridSpan w:val="2"/>'), cell(number)), row(cell(F.lit("a")), cell(F.lit("b")), cell(F.lit("c"))), F.lit("</w:tbl>"),
    )
    rels = F.array(F.struct(F.lit("rId7").alias("id"), F.concat(F.lit("media/"), number, F.lit(".png")).alias("target")), F.struct(F.lit("rId8").alias("id"), F.lit("styles.xml").alias("target")))
    files = docx.pack_docx(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), body.alias("body"), rels.alias("rels")))
    return files.select(F.col("doc_id").cast("string").alias("path"), "content")


@query("""SELECT item_id, unnest(['rId7', 'rId8']) AS rel_id, unnest(['media/' || CAST(item_id AS VARCHAR) || '.png', 'styles.xml']) AS target, unnest([144e0, NULL]) AS width, unnest([72e0, NULL]) AS height FROM benchmark""")
def docx_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships of files, with the size in points of the pictures that use them."""
    files = _docx_files(spark, sf_dir)
    rels, runs = docx.parse_relationships(files), docx_layout.with_targets(docx.parse_files(files), docx.parse_relationships(files))
    used = runs.where("image_rel IS NOT NULL").select("path", F.col("image_rel").alias("rel_id"), "image_w", "image_h")
    return rels.join(used, ["path", "rel_id"], "left").select(F.col("path").cast("bigint").alias("item_id"), "rel_id", "target", F.col("image_w").alias("width"), F.col("image_h").alias("height"))


@query("""SELECT item_id, 0 AS table_seq, 3 AS n_cols, 2 AS n_rows FROM benchmark""")
def docx_table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of each table, cells that span several counted so."""
    t = docx_layout.table_columns(docx.parse_files(_docx_files(spark, sf_dir)))
    return t.select(F.col("path").cast("bigint").alias("item_id"), "table_seq", "n_cols", "n_rows")


@query("""WITH t AS (SELECT item_id, length('Text: ' || replace(text, chr(10), ' ')) AS n FROM benchmark),
h AS (SELECT item_id, 26 AS h0, 156e-1 * greatest(1, ceil(n * 6 / 483.0)) AS h1 FROM t),
y AS (SELECT item_id, 56 + h0 + 4 AS y1, 56 + h0 + 4 + h1 + 4 AS y2 FROM h)
SELECT item_id, unnest([0, 1, 2, 3, 5, 5]) AS block, unnest(['paragraph', 'paragraph', 'paragraph', 'image', 'row', 'row']) AS kind, 0 AS page,
round(CAST(unnest([56, y1, y2, y2 + 156e-1 + 4, y2 + 156e-1 + 4 + 72 + 4 + 14, y2 + 156e-1 + 4 + 72 + 4 + 14 + 236e-1]) AS DOUBLE), 6) AS top FROM y""")
def docx_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files laid out on pages."""
    placed = docx_layout.layout_blocks(docx.parse_files(_docx_files(spark, sf_dir)))
    return placed.select(F.col("path").cast("bigint").alias("item_id"), "block", "kind", "page", r6("top").alias("top"))


@query("""WITH p AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS s, p_partkey % 4 AS c FROM part),
r AS (SELECT *, greatest(2e-2, CASE WHEN c IN (0, 2) THEN s / 100 - 1e-1 ELSE s / 100 + 1e-1 END) AS w, greatest(1e-2, CASE WHEN c IN (0, 1) THEN s / 50 + 5e-2 ELSE s / 50 - 5e-2 END) AS h, least(595 / (20 * s), 842 / 300e0) AS k FROM p)
SELECT p_partkey, round(10 + s - 5e-1 * least(greatest(0, ceil((10 + s - 98 / (6e-1 * s)) / 5e-1)), ceil((6 + s) / 5e-1)), 6) AS shrunk, round(s * 1000 * 72 / 914400, 6) AS points, CAST(trunc(s * 150 / 72) AS INT) AS pixels,
round(greatest(0, least(s / 50 - 1e-1, 8e-1)), 6) AS centred, round(CASE WHEN c IN (0, 2) THEN 5e-1 + s / 100 - w ELSE 5e-1 END, 6) AS left_edge, round(w, 6) AS new_width, round(CASE WHEN c IN (0, 1) THEN 5e-1 + s / 50 - h ELSE 5e-1 END, 6) AS top_edge,
round((595 - 20 * s * k) / 2, 6) AS fit_x, round(300 * k, 6) AS fit_height, round(s / 595, 6) AS box_x, round(1 - (s + 30) / 842, 6) AS box_y, CAST((360 - 90 * c) % 360 AS INT) AS turned, greatest(1, ceil(s * 100 * 5e-1 * 11 / 483)) AS lines FROM r""")
def geometry_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small functions of sizes and places, one column each."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("double")
    corner = F.element_at(F.array(*(F.lit(c) for c in ("tl", "tr", "bl", "br"))), (k % 4 + 1).cast("int"))
    made = table(spark, sf_dir, "part").select(
        "p_partkey", geometry.shrink_font(10 + s, 0.6 * s, F.lit(100.0)).alias("shrunk"), geometry.emu_to_points(s * 1000).alias("points"), geometry.pixels(s, 150.0).alias("pixels"), geometry.centred_on(s / 50, F.lit(0.2)).alias("centred"),
        geometry.resize(corner, F.lit(0.5), F.lit(0.5), s / 100, s / 50, F.lit(0.1), F.lit(-0.05)).alias("r"), geometry.fit(F.lit(595.0), F.lit(842.0), 20 * s, F.lit(300.0)).alias("f"),
        geometry.to_normalised(s, s, s + 40, s + 30, F.lit(595.0), F.lit(842.0)).alias("b"), geometry.rotate(F.lit(0), (-90 * (k % 4)).cast("int")).alias("turned"), docx_layout.line_estimate(s * 100, F.lit(11.0), F.lit(483.0)).alias("lines"),
    )
    place = {"shrunk": "shrunk", "points": "points", "centred": "centred", "r.x": "left_edge", "r.width": "new_width", "r.y": "top_edge", "f.x": "fit_x", "f.height": "fit_height", "b.x": "box_x", "b.y": "box_y"}
    return made.select("p_partkey", "pixels", "turned", F.col("lines").cast("double").alias("lines"), *(r6(c).alias(n) for c, n in place.items()))


@query("""WITH e AS (SELECT conv_id, turn, length(text) AS n FROM conversations), h AS (SELECT conv_id, turn, 12e0 * greatest(1, ceil(n / 40.0)) AS h FROM e)
SELECT conv_id, max(h) AS tallest, sum(h) AS stacked FROM h GROUP BY 1""")
def measure_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation as a row of columns, one a turn, and as one column of all turns: heights of both."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", (12.0 * F.greatest(F.lit(1), F.ceil(F.length("text") / 40.0))).alias("h"))
    node = lambda i, parent, kind, h: F.struct(F.lit(i).cast("string").alias("element_id") if isinstance(i, str) else i.alias("element_id"), parent.cast("string").alias("parent_id"), F.lit(kind).alias("kind"), h.cast("double").alias("own_height"))
    none, name = F.lit(None), F.concat(F.lit("c"), F.col("turn").cast("string"))
    tree = c.select("conv_id", F.explode(F.array(
        node("wide", none, "columns", none), node("high", none, "columns", none), node("all", F.lit("high"), "column", none), node(name, F.lit("wide"), "column", none),
        node(F.concat(name, F.lit("t")), name, "text", F.col("h")), node(F.concat(name, F.lit("u")), F.lit("all"), "text", F.col("h")),
    )).alias("n")).select("conv_id", "n.*").distinct()
    tall = templates.measure(tree, ["conv_id"])
    of = lambda i: F.max(F.when(F.col("element_id") == i, F.col("height")))
    return tall.groupBy("conv_id").agg(of("wide").alias("tallest"), of("high").alias("stacked"))


@query("""SELECT o_custkey, round(sum(CAST(round(o_totalprice * 100) AS BIGINT)) / 100.0, 2) AS total, count(*) AS n FROM orders GROUP BY 1""")
def money_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums over prices that are texts such as $1,234.50; one that is none counts as nothing."""
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    text = F.concat(F.lit("$"), F.format_number(F.floor(cents / 100), 0), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.explode(F.array(text, F.lit("n/a"))).alias("text"))
    value = strings.parse_money(F.col("text"))
    return rows.groupBy("o_custkey").agg(F.round(F.sum(value.cast("decimal(18,2)")).cast("double"), 2).alias("total"), F.count(value).alias("n"))


@query("""SELECT c_custkey AS doc_id, unnest(['typed', 'ticked']) AS section, unnest([CAST(2 AS BIGINT), 1]) AS n FROM customer""")
def form_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields to type in and fields to tick of each customer's form."""
    return forms.partition(_fields(spark, sf_dir)).groupBy("doc_id", "section").agg(F.count("*").alias("n"))


@query(f"""WITH p AS ({PAGES_SQL}), r AS (SELECT item_id AS doc_id, unnest([0, 0, 1, 50]) AS page_index FROM benchmark), n AS (SELECT doc_id, page_index, count(*) AS n FROM r GROUP BY 1, 2),
e AS (SELECT r.doc_id, count(*) AS applied FROM r JOIN p ON p.doc_id = r.doc_id AND p.page_index = r.page_index GROUP BY 1)
SELECT p.doc_id, CAST(p.page_index AS INT) AS page_index, coalesce(n, 0) AS n_areas, coalesce(applied, 0) AS edits_applied FROM p LEFT JOIN n USING (doc_id, page_index) LEFT JOIN e ON e.doc_id = p.doc_id""")
def page_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with the areas that are asked for on them, and how many of a document's areas are on pages that exist."""
    pages = _pages(spark, sf_dir)
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(p).alias("page_index")) for i, p in enumerate((0, 0, 1, 50))))).alias("a")
    areas = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), each).select("doc_id", "a.*", *(F.lit(v).alias(c) for c, v in (("x", 0.0), ("y", 0.0), ("width", 0.5), ("height", 0.1))))
    applied = spatial.edits_applied(areas, pages)
    return spatial.attach(pages, areas).join(applied, "doc_id", "left").select("doc_id", "page_index", F.size("areas").cast("bigint").alias("n_areas"), F.coalesce("edits_applied", F.lit(0)).cast("bigint").alias("edits_applied"))


@query("""WITH j AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)
SELECT event_id, k % 3 AS n_items, CASE WHEN k % 3 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS first, 0 AS n_missing FROM j""")
def json_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays at a path of JSON, empty where there is none."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    data = F.to_json(F.struct(F.struct(F.slice(F.array(k, k + 1), F.lit(1), (k % 3).cast("int")).alias("items")).alias("more")))
    rows = table(spark, sf_dir, "events").select("event_id", (k % 3).alias("k3"), F.parse_json(data).alias("v"))
    items = key_path_list(F.col("v"), "more.items", "bigint")
    return rows.select("event_id", F.size(items).cast("bigint").alias("n_items"), F.coalesce(F.get(items, 0).cast("string"), F.lit("")).alias("first"), F.size(key_path_list(F.col("v"), "no.items", "bigint")).alias("n_missing"))


def queries_loaded() -> None:
    """Importing this module registers its queries."""
