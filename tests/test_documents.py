"""Templates, DOCX layout, viewer joins, recognisers, sinks: small cases by hand and by plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillspark.functions import strings
from quillspark.operators import bookmarks, docx_layout, generate, pages, recognition, security, segmentation, templates, viewer
from quillspark.scratch import materialize, tables
from quillspark.sources import docx, layout, results


def test_wrap_like_a_loop(spark):
    def slow(text, n):
        out = []
        for p in text.split("\n"):
            if not p:
                out.append("")
                continue
            cur = ""
            for w in p.split(" "):
                joined = w if not cur else f"{cur} {w}"
                if len(joined) > n and cur:
                    out.append(cur)
                    cur = w
                else:
                    cur = joined
            if cur:
                out.append(cur)
        return out

    rng = random.Random(1)
    texts = ["", " ", "  ", "a  b", " lead", "trail ", "x" * 30, "a\n\nb"] + [" ".join("é" * rng.randint(0, 9) for _ in range(rng.randint(1, 20))) for _ in range(40)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", templates.wrap(F.col("t"), 12).alias("w")).collect()
    assert all(r.w == slow(r.t, 12) for r in got)


def boxes_of(spark, template, *data):
    rows = spark.createDataFrame([(i, json.dumps(d) if d is not None else None) for i, d in enumerate(data)], "k int, data string")
    return generate.generate(template, rows, ["k"]).orderBy("k", "seq").collect()


def test_template_without_elements_or_data(spark):
    assert boxes_of(spark, {"body": []}, {}) == []
    one = boxes_of(spark, {"body": [{"type": "text", "content": "{{a.b}}{{c}}"}, {"type": "unknown"}], "footer": [{"type": "line"}], "backgroundColor": "#FFFFFF"}, {"a": {"b": 1}}, {"a": 2, "c": None}, None)
    assert [(r.k, r.part, r.kind, r.text) for r in one] == [(0, "background", "fill", None), (0, "footer", "line", None), (0, "body", "text", "1"), (1, "background", "fill", None), (1, "footer", "line", None), (2, "background", "fill", None), (2, "footer", "line", None)]
    assert one[1].y == 842 - 40 - 1 and one[0].width == 595


def test_nested_elements_take_room_but_are_not_drawn(spark):
    table = {"type": "table", "dataKey": "rows", "columns": [{"header": "A", "key": "a", "width": 1}], "marginBottom": 2}
    body = [{"type": "columns", "columns": [{"width": 1, "elements": [table, {"type": "text", "content": "below"}]}]}, {"type": "spacer", "height": 3}, {"type": "text", "content": "next"}]
    got = boxes_of(spark, {"body": body}, {"rows": [{"a": 1}, {"a": 2}]})
    high = 3 * (12 * 1.2 + 12) + 2
    assert [(r.kind, r.drawn, round(r.y, 6)) for r in got] == [("table", False, 40.0), ("text", True, round(40 + high, 6)), ("text", True, round(40 + high + 14.4 + 3, 6))]


def test_pages_break_like_a_loop(spark):
    """Rows of random heights: a break before what does not fit, the header again on each page."""
    rng = random.Random(2)
    for _ in range(4):
        n, row_h, room = rng.randint(0, 40), rng.choice([17.0, 25.5]), rng.choice([120.0, 200.0])
        template = {"pageSize": {"width": 200, "height": room + 20}, "margins": {"top": 10, "bottom": 10, "left": 5, "right": 5}, "body": [
            {"type": "spacer", "height": rng.randint(0, 60)}, {"type": "table", "dataKey": "d.rows", "rowHeight": row_h, "showGridLines": False, "columns": [{"header": "H", "key": "v", "width": 1}]}, {"type": "spacer", "height": 50}, {"type": "text", "content": "end"}]}
        rows = [{"v": f"r{i}"} if i % 5 else {"w": "other"} for i in range(n)]
        got = [(r.page, round(r.y, 6), r.text) for r in boxes_of(spark, template, {"d": {"rows": rows}}) if r.kind in ("head", "cell") or r.text == "end"]
        page, cursor, bottom, head, want = 0, 10.0 + template["body"][0]["height"], room + 10.0, 12 * 1.2 + 12, []

        def ask(need):
            nonlocal page, cursor
            if cursor + need > bottom:
                page, cursor = page + 1, 10.0
                return True
            return False

        ask(head + row_h)
        want.append((page, cursor, None))
        cursor += head
        for r in rows:
            if ask(row_h):
                want.append((page, cursor, None))
                cursor += head
            want.append((page, cursor + row_h - 6 - 12, r.get("v", "")))
            cursor += row_h
        ask(50.0)
        cursor += 50
        ask(14.4)
        want.append((page, cursor, "end"))
        assert got == [(p, round(y, 6), t) for p, y, t in want]


def test_values_are_templates_in_cells_only(spark):
    template = {"body": [{"type": "text", "content": "{{x}}"}, {"type": "table", "dataKey": "r", "showGridLines": False, "columns": [{"header": "H", "key": "c", "width": 1}]}]}
    got = [r.text for r in boxes_of(spark, template, {"x": "{{y}}", "y": "deep", "r": [{"c": "{{y}}!"}, {"c": "{{none}}"}, {"c": 1.5}, {"c": True}]}) if r.text is not None]
    assert got == ["{{y}}", "H", "deep!", "", "1.5", "true"]


def test_several_moves_turns_and_inserts(spark):
    rng = random.Random(3)
    n = 9
    p = spark.createDataFrame([(d, i, 100.0, 200.0, 0) for d in range(5) for i in range(n)], "doc_id int, page_index int, width double, height double, rotation int")
    moves = [(d, o, rng.randint(-1, n), rng.randint(-1, n)) for d in range(4) for o in range(d * 2)]
    got = {(r.doc_id, r.page_index): r.from_page for r in pages.move(p, spark.createDataFrame(moves, "doc_id int, ord int, source int, target int")).collect()}
    for d in range(5):
        there = list(range(n))
        for _, _, s, t in sorted(m for m in moves if m[0] == d):
            if 0 <= s < n and 0 <= t < n:
                there.insert(t, there.pop(s))
        assert [got[d, i] for i in range(n)] == there
    new = [(d, o, rng.randint(0, n + o), 1.0 + o, 5.0) for d in range(4) for o in range(d * 2)]
    rows = pages.insert(p, spark.createDataFrame(new, "doc_id int, ord int, page_index int, width double, height double")).collect()
    for d in range(5):
        there = [100.0] * n
        for _, _, at, w, _ in sorted(x for x in new if x[0] == d):
            there.insert(at, w)
        assert [w for _, w in sorted((r.page_index, r.width) for r in rows if r.doc_id == d)] == there
    turns = spark.createDataFrame([(0, 0, 90), (0, 0, 90), (0, 1, 90), (0, 1, 180), (0, 2, -90)], "doc_id int, page_index int, degrees int")
    got = {(r.doc_id, r.page_index): (r.width, r.rotation) for r in pages.rotate_pages(p, turns).collect()}
    assert len(got) == 5 * n and [got[0, i] for i in range(4)] == [(100.0, 180), (200.0, 270), (200.0, 270), (100.0, 0)]


def test_deep_outlines_and_long_chains(spark):
    deep = spark.createDataFrame([(1, i, i - 1 if i else None, 0, f"n{i}") for i in range(70)] + [(2, 500, 501, 0, "lost"), (2, 501, 500, 0, "lost")], "doc_id bigint, node_id bigint, parent_id bigint, ord int, title string")
    flat = bookmarks.flatten(deep).orderBy("seq").collect()
    assert [(r.seq, r.level, r.title) for r in flat] == [(i, i, f"n{i}") for i in range(70)]
    rng = random.Random(4)
    items = [(d, o, f"t{o}", rng.randint(-1, 3), 3, rng.randint(-2, 12)) for d in (1, 2) for o in range(30)]
    present = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (1, 2, 1)], "doc_id bigint, seq int, level int")
    got = {(r["doc_id"], r["index"]): (r.title, r.parent, r.level) for r in bookmarks.add(present, spark.createDataFrame(items, "doc_id bigint, ord int, title string, page_index int, page_count int, parent_index int")).collect()}
    want = {}
    for d, levels in ((1, [0, 1, 1]), (2, [])):
        for _, _, title, page, count, p in (x for x in items if x[0] == d):
            if 0 <= page < count:
                known = 0 <= p < len(levels)
                want[d, len(levels)] = (title, p if known else -1, levels[p] + 1 if known else 0)
                levels.append(want[d, len(levels)][2])
    assert got == want


def test_blank_is_any_white_space(spark):
    rows = spark.createDataFrame([(1, 0, "\t   "), (2, 0, " x")], "doc_id int, page_index int, text string")
    got = segmentation.auto_extract(rows, rows.selectExpr("doc_id", "page_index", "'ocr' AS text")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, "ocr"), (2, " x")]
    assert rows.select(strings.strip(F.col("text")).alias("t")).collect()[0].t == ""


def test_layout_of_pages(spark):
    docs = spark.createDataFrame([(1, "ab c\n\nd"), (2, ""), (3, None)], "doc_id int, text string")
    got = segmentation.words(layout.page_glyphs(docs), layout.PAGE_W, layout.PAGE_H).collect()
    assert sorted((r.doc_id, r.block_seq, r.text) for r in got) == [(1, 0, "ab"), (1, 1, "c"), (1, 2, "d")]
    assert layout.glyphs(docs).count() == 5 and segmentation.words(segmentation.pack(layout.glyphs(docs)), 595.0, 842.0, width_rule="last", clamp_all=False).count() == 3


def test_recognizer_hook(spark):
    def make():
        def engine(image, language):
            if image == b"bad":
                raise ValueError("no image")
            return [(word, 0.1 * i, 0.2, 0.1, 0.05, 0.9) for i, word in enumerate(image.decode().split())] + [(language, 0.0, 0.0, 1.0, 1.0, 0.5)]

        return engine

    images = spark.createDataFrame([(1, 0, bytearray(b"two words")), (1, 1, bytearray(b"bad")), (2, 0, None)], "doc_id int, page_index int, image binary")
    got = recognition.recognize(images, make, "de").orderBy("page_index", "block_seq").collect()
    assert [(r.page_index, r.block_seq, r.text, r.mode) for r in got] == [(0, 0, "two", "ocr"), (0, 1, "words", "ocr"), (0, 2, "de", "ocr"), (1, None, None, "ocr")]
    assert got[3].error == "ValueError: no image"


def test_encryption_round_trip(spark):
    files = spark.createDataFrame([(1, bytearray(b"secret")), (2, bytearray(b"")), (3, None)], "doc_id int, content binary")
    hidden = materialize(security.encrypt(files, "pass"), "hidden")
    assert all(r.content is None or b"secret" not in bytes(r.content) for r in hidden.collect())
    back = {r.doc_id: (r.content and bytes(r.content), r.error) for r in security.decrypt(hidden, "pass").collect()}
    assert back == {1: (b"secret", None), 2: (bytearray(b""), None), 3: (None, None)}
    assert [r.error for r in security.decrypt(hidden, "other").orderBy("doc_id").collect()] == ["wrong password", "wrong password", None]


def test_sinks(spark, tmp_path):
    df = spark.range(3)
    path = results.save_to(df, str(tmp_path), "merged")
    assert path.endswith("/merged.parquet") and results.save_to(spark.range(5), str(tmp_path), "Merged.parquet".lower()) == path
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(Exception):
        results.save_to(df, str(tmp_path), "merged", overwrite=False)
    got = results.checked(spark.createDataFrame([("a", bytearray(b"12345")), ("b", bytearray(b"1")), ("c", None)], "path string, content binary"), 4).collect()
    assert [(r.path, r.error_code) for r in got] == [("a", None), ("b", "INVALID_INPUT"), ("c", "INVALID_INPUT")]


def test_cleanup(spark):
    made = materialize(spark.range(2), "doomed")
    assert made._quillspark_path in tables()
    before = set(tables())
    assert results.cleanup_temp(spark) == len(before) and not tables()


def test_viewer_edges(spark):
    boxes = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, -1.0)], "id int, width double")
    assert [r.id for r in viewer.positive_boxes(boxes).collect()] == [2]
    order = lambda seed: [r.id for r in viewer.shuffled(boxes, seed).collect()]
    assert order(1) == order(1) and sorted(order(2)) == [1, 2, 3]
    texts = spark.createDataFrame([(1, "[]"), (2, None), (3, "nonsense"), (4, '[{"id": "a", "pageIndex": 0, "x": 0, "y": 0, "width": 1, "height": 1}, {"id": "b"}]')], "doc_id int, overlays string")
    assert [(r.doc_id, r.overlay_id, r.label) for r in viewer.parse_overlays(texts).collect()] == [(4, "a", "")]
    paths = spark.createDataFrame([("file:///a%20b+c",), ("/a%20b",)], "u string").select(strings.local_path(F.col("u")).alias("p")).collect()
    assert [r.p for r in paths] == ["/a b+c", "/a%20b"]


def test_docx_broken_files_and_page_breaks(spark):
    p = "<w:p><w:r><w:t>line</w:t></w:r></w:p>"
    files = docx.pack_docx(spark.createDataFrame([(1, p * 60), (2, None)], "doc_id bigint, body string")).selectExpr("CAST(doc_id AS string) AS path", "content")
    files = files.unionByName(spark.createDataFrame([("bad", bytearray(b"no zip")), ("none", None)], "path string, content binary"))
    runs = materialize(docx.parse_files(files), "runs")
    assert {r.path for r in runs.where("error IS NOT NULL").collect()} == {"bad", "none"}
    placed = docx_layout.layout_blocks(runs, "Letter").orderBy("block").collect()
    page, cursor, want = 0, 56.0, []
    for i in range(60):
        if cursor + 15.6 > 792 - 56:
            page, cursor = page + 1, 56.0
        want.append((i, page, round(cursor, 6)))
        cursor += 15.6 + 4
    assert [(r.block, r.page, round(r.top, 6)) for r in placed] == want
    assert docx.parse_relationships(files).where("rel_id IS NOT NULL").count() == 0


def test_pictures_and_font_estimates(spark):
    from quillspark.functions import geometry
    from quillspark.operators import docx_xml

    xml = spark.range(1).select(F.lit(1).alias("doc_id"), docx_xml.picture_xml(F.lit("rId3"), F.lit(595.0), F.lit(842.0), F.lit(4)).alias("body"), F.array(F.struct(F.lit("rId3").alias("id"), F.lit("media/p.png").alias("target"))).alias("rels"))
    files = docx.pack_docx(xml).selectExpr("CAST(doc_id AS string) AS path", "content")
    r = docx_layout.with_targets(docx.parse_files(files), docx.parse_relationships(files)).first()
    assert (r.image_rel, r.image_target) == ("rId3", "media/p.png") and abs(r.image_w - 595 * 0.9) < 1e-3 and abs(r.image_h - 842 * 0.9) < 1e-3
    got = spark.range(1).select(*(geometry.layer_font(F.lit(h)).alias(str(h)) for h in (1.0, 10.0, 900.0)), geometry.recognised_font(F.lit(0.02), 842.0).alias("r")).first()
    assert tuple(got)[:3] == (4.0, 8.0, 72.0) and abs(got.r - 0.85 * 0.02 * 842) < 1e-9
