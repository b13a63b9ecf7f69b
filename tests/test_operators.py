"""Operators against plain loops over small inputs."""

import io
import random
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark import scratch
from quillspark.functions import colors, geometry, strings
from quillspark.functions import templates as bind_functions
from quillspark.operators import bookmarks, diff, docx_xml, forms, pages, segmentation, spatial, templates
from quillspark.sources import docx, layout
from quillspark.streaming import page_events


def full_table(a, b):
    """Operations by the whole table of common subsequence lengths."""
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        for j in range(m):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i].lower() == b[j].lower() else max(best[i][j + 1], best[i + 1][j])
    out, i, j = [], n, m
    while i + j:
        if i and j and a[i - 1].lower() == b[j - 1].lower():
            i, j = i - 1, j - 1
            out.append(("E", i, j))
        elif j and (i == 0 or best[i][j - 1] >= best[i - 1][j]):
            j -= 1
            out.append(("I", -1, j))
        else:
            i -= 1
            out.append(("D", i, -1))
    return out[::-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcdE"), max_size=14), st.lists(st.sampled_from("abcdeF"), max_size=14))
def test_lcs_ops(a, b):
    assert diff.lcs_ops(a, b) == full_table(a, b)


def alike(a, b):
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    if max(len(a), len(b)) > 30:
        k = 0
        while k < min(len(a), len(b)) and a[k] == b[k]:
            k += 1
        return 2 * k / (len(a) + len(b))
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return 1 - row[-1] / max(len(a), len(b))


def counts_by_queue(a, b):
    """Added, deleted, changed: deletes wait in a queue until an insert fits the first or something else comes."""
    added = deleted = changed = 0
    queue = []
    for op, i, j in full_table(a, b):
        if op == "D":
            queue.append(a[i])
        elif op == "I" and queue and alike(queue[0], b[j]) > 0.8:
            queue.pop(0)
            changed += 1
        else:
            deleted += len(queue)
            queue = []
            added += op == "I"
    return added, deleted + len(queue), changed


def test_change_counts(spark):
    rng = random.Random(3)
    base = ["hello", "wonderful", "abcdefghij", "x" * 40, "Short", "ab", "ä", "é" * 12]

    def vary(w):
        k = rng.random()
        return w[:-1] + "q" if k < 0.3 else w.upper() if k < 0.4 else w + "zz" if k < 0.5 else w

    old = {p: [rng.choice(base) for _ in range(rng.randint(0, 12))] for p in range(120)}
    new = {p: [vary(w) for w in ws if rng.random() > 0.15] + [rng.choice(base)] * rng.randint(0, 2) for p, ws in old.items()}
    frame = lambda d: spark.createDataFrame([(p, 0, w) for p, w in d.items()], "pair_id bigint, page_index int, words array<string>")
    got = {r.pair_id: (r.added, r.deleted, r.changed) for r in diff.compare(frame(old), frame(new)).collect()}
    for p in old:
        assert got.get(p, (0, 0, 0)) == counts_by_queue(old[p], new[p])


def test_ratio_edges(spark):
    pairs = [("abcde", "abcdx"), ("", "a"), ("", ""), ("A", "a"), ("a" * 31, "a" * 30 + "b"), ("kitten", "sitting"), ("x" * 40, "y"), ("äöü", "aou")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", strings.fuzzy_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert all(abs(r.r - alike(r.a, r.b)) < 1e-12 for r in rows)


def test_unpaired_pages(spark):
    a = spark.createDataFrame([(1, 0, ["x"]), (1, 1, ["y"])], "pair_id bigint, page_index int, words array<string>")
    got = {(r.page_index1, r.page_index2): (r.added, r.deleted) for r in diff.compare(a, a.where("page_index = 0")).collect()}
    assert got == {(0, 0): (0, 0), (1, -1): (0, 1)}


def test_words_break_at_gaps_and_lines(spark):
    chars = [(1, 0, i, c, x, y, 6.0, 10.0, 10.0, "F") for i, (c, x, y) in enumerate([(" ", 0.0, 20.0), ("a", 6.0, 20.0), ("b", 12.0, 20.0), ("c", 20.5, 20.0), ("d", 26.5, 26.0), ("ﬁ", 32.5, 26.0), (" ", 38.5, 26.0), ("😀", 44.5, 26.0)])]
    df = spark.createDataFrame(chars, "doc_id bigint, page_index int, seq bigint, ch string, x double, y double, width double, height double, font_size double, font_name string")
    got = [r.text for r in segmentation.words(segmentation.pack(df), 595.0, 842.0).orderBy("block_seq").collect()]
    assert got == ["ab", "c", "dﬁ", "😀"]


def test_merge_then_split(spark):
    docs = spark.createDataFrame([(1, "a\n" * 130), (2, "b"), (3, None)], "doc_id bigint, text string")
    p = layout.pages(docs)
    inputs = spark.createDataFrame([(9, 0, 2), (9, 1, 1), (9, 2, 2)], "out_id bigint, pos int, doc_id bigint")
    merged = pages.merge(p, inputs).orderBy("page_index").collect()
    assert [(r.page_index, r.from_doc, r.from_page) for r in merged] == [(0, 2, 0), (1, 1, 0), (2, 1, 1), (3, 1, 2), (4, 2, 0)]
    parts = pages.split(p, spark.createDataFrame([(1, 0, 1, 9), (1, 1, 0, 1)], "doc_id bigint, part int, first int, last int")).collect()
    assert sorted((r.part, r.page_index, r.from_page) for r in parts) == [(0, 0, 1), (0, 1, 2), (1, 0, 0), (1, 1, 1)]
    gone = spark.createDataFrame([(2, 0), (2, 0), (1, 7)], "doc_id bigint, page_index int")
    assert pages.delete(p, gone).count() == 3 and pages.delete(p, gone, keep_one=True).count() == 4


def test_colors(spark):
    rows = spark.createDataFrame([("#FFAA00",), ("ffaa00",), ("#FFF",), ("#GG0000",), ("",), (None,)], "t string").select(colors.parse_hex(F.col("t"), (1, 2, 3)).alias("c")).collect()
    assert [tuple(r.c) for r in rows] == [(255, 170, 0)] * 2 + [(1, 2, 3)] * 4


def test_bind_is_single_pass(spark):
    df = spark.createDataFrame([("{{a}}-{{ b }}-{{}}-{{x",), ("plain",), ("",)], "t string")
    got = [r.s for r in df.select(bind_functions.bind(F.col("t"), lambda k: F.when(k == "a", "{{b}}").when(k == " b ", "B")).alias("s")).collect()]
    assert got == ["{{b}}-B-{{}}-{{x", "plain", ""]


def test_appearance_and_names(spark):
    df = spark.createDataFrame([("/Helv 12 Tf 0 g",), ("0 g",), ("Tf",), ("12 Tf",)], "da string")
    assert [tuple(r.f) for r in df.select(strings.appearance_font(F.col("da")).alias("f")).collect()] == [("Helv", 12.0), (None, None), (None, None), (None, None)]
    one = spark.range(1).select(
        strings.heading_digits(F.lit("Heading 2")).alias("a"), strings.heading_digits(F.lit("Title")).alias("b"), strings.ensure_suffix(F.lit("x.PDF")).alias("c"), strings.ensure_suffix(F.lit("x")).alias("d"),
        strings.default_field_name(F.lit("   "), F.lit(3)).alias("e"), strings.parse_money(F.lit("$1,234.50")).alias("f"), strings.font_alias(F.lit("Times New")).alias("g"),
    ).first()
    assert tuple(one) == (2, 1, "x.PDF", "x.pdf", "Field 3", 1234.5, "Times-Roman")


def test_geometry(spark):
    box = geometry.resize(F.lit("tl"), F.lit(0.5), F.lit(0.5), F.lit(0.2), F.lit(0.2), F.lit(0.3), F.lit(0.1))
    r = spark.range(1).select(box.alias("b"), geometry.rotate(F.lit(0), -90).alias("t"), geometry.shrink_font(F.lit(4.2), F.lit(100.0), F.lit(10.0)).alias("s"), geometry.fit(F.lit(100.0), F.lit(200.0), F.lit(50.0), F.lit(50.0)).alias("f")).first()
    assert r.b.width == pytest.approx(0.02) and r.b.x == pytest.approx(0.68) and r.t == 270 and r.s == pytest.approx(3.7)
    assert tuple(r.f) == (0.0, 50.0, 100.0, 100.0)


def test_pagination(spark):
    heights = [30.0, 50.0, 20.0, 200.0, 10.0, 95.0]
    df = spark.createDataFrame([(1, i, h) for i, h in enumerate(heights)], "k int, i int, h double")
    got = [(r.page, r.top) for r in templates.paginate(df, ["k"], ["i"], "h", 100.0).orderBy("i").collect()]
    page, cursor, want = 0, 0.0, []
    for h in heights:
        if cursor + h > 100:
            page, cursor = page + 1, 0.0
        want.append((page, cursor))
        cursor += h
    assert got == want


def test_wrap(spark):
    df = spark.createDataFrame([("aa bb cccccccccccc d\n\ne",)], "t string")
    assert df.select(templates.wrap(F.col("t"), 5).alias("w")).first().w == ["aa bb", "cccccccccccc", "d", "", "e"]


def test_spatial(spark):
    p = spark.createDataFrame([(1, 0, 10.0, 10.0), (1, 0, 300.0, 10.0), (1, 1, 10.0, 10.0)], "doc_id bigint, page_index int, x double, y double")
    r = spark.createDataFrame([(1, 0, 24.0, 0.0, 5.0, 5.0)], "doc_id bigint, page_index int, x double, y double, width double, height double")
    assert sorted((q.page_index, q.x) for q in spatial.remove_in_regions(p, r).collect()) == [(0, 300.0), (1, 10.0)]


def test_fill_last_value_wins(spark):
    f = spark.createDataFrame([(1, "a", "text", "old"), (1, "b", "checkbox", "Off"), (1, "c", "text", "keep")], "doc_id bigint, id string, type string, value string")
    v = spark.createDataFrame([(1, "a", 2, "new"), (1, "a", 1, "older"), (1, "b", 1, "1"), (1, "zz", 1, "x")], "doc_id bigint, id string, ord int, value string")
    assert {r.id: r.value for r in forms.fill(f, v).collect()} == {"a": "new", "b": "Yes", "c": "keep"}


def test_bookmarks(spark):
    nodes = spark.createDataFrame([(1, 1, None, 0, "A"), (1, 2, 1, 0, "A1"), (1, 3, 2, 0, "A1a"), (1, 4, None, 1, "B"), (1, 9, 99, 0, "lost")], "doc_id bigint, node_id bigint, parent_id bigint, ord bigint, title string")
    flat = bookmarks.flatten(nodes)
    assert [(r.seq, r.title, r.level, r.children) for r in flat.orderBy("seq").collect()] == [(0, "A", 0, 1), (1, "A1", 1, 1), (2, "A1a", 2, 0), (3, "B", 0, 0)]
    gone = spark.createDataFrame([(1, 1), (1, 1), (1, 50)], "doc_id bigint, seq int")
    assert [(r.seq, r.title) for r in bookmarks.remove(flat, gone).orderBy("seq").collect()] == [(0, "A"), (1, "B")]
    items = spark.createDataFrame([(1, 0, "x", 0, 5, 1), (1, 1, "skip", 9, 5, None), (1, 2, "y", 1, 5, 4), (1, 3, "z", 1, 5, 77)], "doc_id bigint, ord int, title string, page_index int, page_count int, parent_index int")
    assert sorted(tuple(r) for r in bookmarks.add(flat, items).collect()) == [(1, 4, "x", 1, 2), (1, 5, "y", 4, 3), (1, 6, "z", -1, 0)]


def test_docx_tables_and_damage(spark):
    body = '<w:tbl><w:tr><w:tc><w:tcPr><w:gridSpan w:val="2"/></w:tcPr><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:pPr><w:numPr><w:numId w:val="3"/></w:numPr></w:pPr><w:r><w:t>i</w:t><w:tab/></w:r></w:p>'
    good = docx.pack_docx(spark.createDataFrame([(1, body)], "doc_id bigint, body string")).first().content
    buf = io.BytesIO()
    zipfile.ZipFile(buf, "w").close()
    files = spark.createDataFrame([("good", bytearray(good)), ("bad", bytearray(b"nope")), ("empty", bytearray(buf.getvalue())), ("none", None)], "path string, content binary")
    got = docx.parse_files(files).collect()
    assert [(r.text, r.table_seq, r.grid_span, r.is_list) for r in got if r.path == "good"] == [("c", 0, 2, False), ("i\t", None, None, True)]
    assert {r.path for r in got if r.error} == {"bad", "empty", "none"}


def test_xml_escape(spark):
    r = spark.range(1).select(strings.xml_escape(F.lit("<a & 'b' \"c\">")).alias("x"), docx_xml.run_xml(F.lit("t"), F.lit(10.5), F.lit("Foo-Bold")).alias("r")).first()
    assert r.x == "&lt;a &amp; &apos;b&apos; &quot;c&quot;&gt;" and '<w:b/><w:sz w:val="21"/>' in r.r


def test_stream_equals_batch(spark, tmp_path):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id * 7) AS ts, concat('t', id % 3) AS event_type FROM range(500)")
    df.repartition(3).write.parquet(str(tmp_path / "e"))
    streamed = page_events.replay(spark, str(tmp_path / "e"), str(tmp_path / "e"))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, page_events.windowed_counts(spark.read.parquet(str(tmp_path / "e"))).collect()))


def test_shared_folder_is_never_local_on_a_cluster(monkeypatch):
    class Conf:
        def __init__(self, root):
            self.root = root

        def get(self, key, default):
            return self.root

        def set(self, key, value):
            self.root = value

    class Session:
        def __init__(self, master, root=None):
            self.conf, self.sparkContext = Conf(root), type("C", (), {"master": master})

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://x"):
        with pytest.raises(RuntimeError):
            scratch.shared_root(Session(master))
        assert scratch.shared_root(Session(master, "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("local", "local[4]", "local[*]"):
        assert scratch.shared_root(Session(master)).startswith("file:///")
