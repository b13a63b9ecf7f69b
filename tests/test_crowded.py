"""Viewer joins where a page has many overlays or a document many pages: whole results, in work that does not grow with the pairs."""

import math
import random
import threading
from contextlib import contextmanager

from pyspark.sql import functions as F

from quillspark.operators import spatial, viewer


@contextmanager
def at_most(spark, seconds):
    """Jobs begun inside are cancelled after ``seconds``."""
    spark.sparkContext.setJobGroup("crowded", "crowded", True)
    timer = threading.Timer(seconds, spark.sparkContext.cancelJobGroup, ["crowded"])
    timer.start()
    try:
        yield
    finally:
        timer.cancel()
        spark.sparkContext.setJobGroup("rest", "rest")


def test_hit_test_on_a_crowded_page(spark):
    n = 30_000
    points = spark.range(n).select(F.col("id").alias("point_id"), F.lit(0).alias("page_index"), (F.col("id") + 0.5).alias("x"), F.lit(1.0).alias("y"))
    overlays = spark.range(n).select(F.col("id").alias("overlay_id"), F.col("id").alias("ord"), F.lit(0).alias("page_index"), F.col("id").cast("double").alias("x"), F.lit(0.0).alias("y"), F.lit(float(n)).alias("width"), F.lit(2.0).alias("height"))
    with at_most(spark, 60):
        wrong = spatial.hit_test(points, overlays).where("overlay_id != point_id OR n_hits != point_id + 1 OR overlay_id IS NULL")
        assert wrong.count() == 0
        assert spatial.hit_test(points, overlays).count() == n


def test_hit_test_parts_blocks_and_odd_values(spark, monkeypatch):
    rnd = random.Random(1)
    nan, inf = math.nan, math.inf
    v = lambda: rnd.choice([None, nan, inf, 0.0, -0.0, 1.0, 2.0, -4.0]) if rnd.random() < 0.3 else rnd.randrange(-10, 24) / 2
    points = [(rnd.choice([i, i // 2]), rnd.choice([None, 0, 1, 2]), v(), v()) for i in range(300)]
    overlays = [(f"o{i}", rnd.randrange(40), rnd.choice([None, 0, 1, 3]), v(), v(), v(), v()) for i in range(150)]
    big = lambda a: (1, 0.0) if math.isnan(a) else (0, a)
    want = {}
    for i, page, *place in points:
        for o, rank, o_page, *box in overlays:
            spans = [(place[k], box[k], None if None in (box[k], box[k + 2]) else box[k] + box[k + 2]) for k in (0, 1)]
            if page is not None and page == o_page and not any(None in s for s in spans) and all(big(lo) <= big(p) <= big(hi) for p, lo, hi in spans):
                best, n = want.get(i, ((-1, ""), 0))
                want[i] = (max(best, (rank, o)), n + 1)
    p = spark.createDataFrame(points, "point_id int, page_index int, x double, y double")
    o = spark.createDataFrame(overlays, "overlay_id string, ord int, page_index bigint, x double, y double, width double, height double")
    for group, bits, buckets in ((100_000, 4096, 2048), (40, 32, 2)):
        monkeypatch.setattr(spatial, "GROUP", group)
        monkeypatch.setattr(spatial, "BUCKETS", buckets)
        monkeypatch.setattr(spatial, "BITS", bits)
        got = {r.point_id: ((r.overlay_id), r.n_hits) for r in spatial.hit_test(p, o).collect()}
        assert got == {i: (best[1], n) for i, (best, n) in want.items()} and len(got) > 50


def _pages(spark, n):
    """Pages of one document, 40 high, 10 apart."""
    return spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").cast("int").alias("page_index"), (50.0 * F.col("id")).alias("page_top"), F.lit(200.0).alias("page_width"), F.lit(40.0).alias("page_height"))


def _odd_extents(seed):
    """Pages (doc_id, page_index, page_top, page_width, page_height) and marks (id, doc_id, place, size), some on the edges of cells and pages or not numbers."""
    rnd = random.Random(seed)
    odd = [None, math.nan, math.inf, -math.inf, 0.0, 8.0, 64.0, 64.00000000000001, 1e17, 1e17 + 64, -3.0, 5e-324, 1e308]
    v = lambda a, b: rnd.choice(odd) if rnd.random() < 0.15 else rnd.choice([float(rnd.randrange(a, b)), rnd.uniform(a, b), 10.0 ** rnd.uniform(-6, 3)])
    pages = [(rnd.choice([1, 2, 4]), i, v(-10, 400), 200.0, v(1, 70)) for i in range(120)]
    return [p for p in pages if p[4] != 0], [(i, rnd.choice([None, 1, 2, 3]), v(-20, 400), v(0, 100)) for i in range(200)]


#: Spark's order of doubles: NaN is the greatest and equals itself.
def _big(a):
    return (1, 0.0) if math.isnan(a) else (0, a)


def test_nearest_page_of_a_long_document(spark):
    n = 300_000
    views = spark.range(n).select(F.col("id").alias("view_id"), F.lit(1).alias("doc_id"), (50.0 * F.col("id") + 5).alias("top"), F.lit(60.0).alias("height"))
    with at_most(spark, 60):
        got = viewer.nearest_page(views, _pages(spark, n)).agg(F.count("*"), F.count_if(F.col("page_index") == F.col("view_id"))).first()
    assert tuple(got) == (n, n)


def test_nearest_page_odd_values(spark):
    pages, marks = _odd_extents(3)
    want = {}
    for i, doc, top, height in marks:
        seen = []
        for d, index, p_top, _, p_height in pages:
            if d == doc and None not in (top, height, p_top, p_height) and _big(p_top) < _big(top + height) and _big(p_top + p_height) > _big(top):
                seen.append((_big(abs(p_top + p_height / 2 - top - height / 2)), index))
        if seen:
            want[i] = min(seen)[1]
    views = spark.createDataFrame(marks, "view_id int, doc_id int, top double, height double")
    got = viewer.nearest_page(views, spark.createDataFrame(pages, "doc_id int, page_index int, page_top double, page_width double, page_height double"))
    assert sorted(map(tuple, got.collect())) == sorted(want.items()) and len(want) > 50


def test_tap_on_a_long_document(spark):
    n = 300_000
    taps = spark.range(n).select(F.col("id").alias("tap_id"), F.lit(1).alias("doc_id"), F.lit(50.0).alias("tap_x"), (50.0 * F.col("id") + 10).alias("tap_y"))
    with at_most(spark, 60):
        got = viewer.tap_to_page(taps, _pages(spark, n)).agg(F.count("*"), F.count_if((F.col("page_index") == F.col("tap_id")) & (F.col("x") == 0.25) & (F.col("y") == 0.25))).first()
    assert tuple(got) == (n, n)


def test_tap_odd_values(spark):
    pages, marks = _odd_extents(4)
    want = {}
    for i, doc, y, _ in marks:
        on = [index for d, index, top, _, height in pages if d == doc and None not in (y, top, height) and _big(top) <= _big(y) <= _big(top + height)]
        if on:
            want[i] = min(on)
    taps = spark.createDataFrame([(i, doc, 50.0, y) for i, doc, y, _ in marks], "tap_id int, doc_id int, tap_x double, tap_y double")
    got = viewer.tap_to_page(taps, spark.createDataFrame(pages, "doc_id int, page_index int, page_top double, page_width double, page_height double"))
    assert sorted((r.tap_id, r.page_index) for r in got.collect()) == sorted(want.items()) and len(want) > 50


def test_taps_round_halves_as_the_sql(spark, tmp_path):
    import duckdb
    from quillspark.plans import catalog

    spark.createDataFrame([(0, 0, 4.31), (1, 0, 1.17)], "event_id bigint, user_id bigint, value double").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(0, 22)], "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    con = duckdb.connect()
    for t in ("events", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = sorted(map(tuple, catalog.queries()["tap_to_page"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalog.oracle_sql()["tap_to_page"]).fetchall()) and len(got) == 2
