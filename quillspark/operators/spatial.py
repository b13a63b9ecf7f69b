"""Joins of points and boxes. Every one has the page as equality key, so it plans as a hash or merge join; the hit test, where a point may hit
thousands of overlays, deals pages to buckets and counts bits in Arrow groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAGE = ["doc_id", "page_index"]
#: Of the hit test: buckets of pages, rows of a bucket that are looked at together, overlays in a table of bits.
BUCKETS, GROUP, BITS = 2048, 100_000, 4096


def remove_in_regions(points: DataFrame, regions: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """``points`` (doc_id, page_index, x, y, ...) without those in any of ``regions`` (x, y, width, height), by a tolerance."""
    r = regions.select(*(F.col(c).alias("r_" + c) for c in (*PAGE, "x", "y", "width", "height")))
    x, y = F.col("x"), F.col("y")
    inside = (x >= F.col("r_x") - tolerance) & (x <= F.col("r_x") + F.col("r_width") + tolerance) & (y >= F.col("r_y") - tolerance) & (y <= F.col("r_y") + F.col("r_height") + tolerance)
    return points.join(r, (points["doc_id"] == F.col("r_doc_id")) & (points["page_index"] == F.col("r_page_index")) & inside, "left_anti")


def hit_test(points: DataFrame, overlays: DataFrame, slop: float = 0.0) -> DataFrame:
    """point_id, overlay_id: for each of ``points`` (point_id, page_index, x, y) the last of the overlays
    (overlay_id, ord, page_index, x, y, width, height) that it hits, and n_hits, how many it hits.

    No row is made for a hit. Pages are dealt to buckets; there a point's overlays are the bits that its x and its y share
    (:func:`_last_hits`). A bucket with many points or overlays is cut into parts of points and blocks of overlays, each pair of
    which meets once. Coordinates are compared as doubles.
    """
    kind = points.select("page_index").union(overlays.select("page_index")).schema[0].dataType
    key = F.col("page_index").cast(kind)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket")
    span = lambda c, size: ((F.col(c) - slop).cast("double").alias(f"{c}_from"), (F.col(c) + F.col(size) + slop).cast("double").alias(f"{c}_to"))
    p = points.select(bucket, "point_id", key.alias("page"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where("page IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL")
    o = overlays.select(bucket, "overlay_id", "ord", key.alias("page"), *span("x", "width"), *span("y", "height")).where("page IS NOT NULL AND x_from IS NOT NULL AND x_to IS NOT NULL AND y_from IS NOT NULL AND y_to IS NOT NULL")
    count = lambda d, name: d.groupBy("bucket").agg(F.ceil(F.count("*") / GROUP).cast("int").alias(name))
    deal = F.broadcast(count(p, "parts").join(count(o, "blocks"), "bucket"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = lambda n, *by: F.pmod(F.xxhash64(*by), F.col(n)).cast("int")
    p = p.join(deal, "bucket").select("bucket", dealt("parts", "point_id", "x", "y").alias("part"), each("blocks").alias("block"), "point_id", "page", "x", "y")
    o = o.join(deal, "bucket").select("bucket", each("parts").alias("part"), dealt("blocks", "overlay_id", "ord", "x_from", "y_from").alias("block"), "overlay_id", "ord", "page", "x_from", "x_to", "y_from", "y_to")
    group = ["bucket", "part", "block"]
    types = {c: d.schema[c].dataType.simpleString() for d in (p, o) for c in d.columns}
    hits = p.groupBy(*group).cogroup(o.groupBy(*group)).applyInArrow(_last_hits, f"point_id {types['point_id']}, overlay_id {types['overlay_id']}, ord {types['ord']}, n bigint")
    return hits.groupBy("point_id").agg(F.max_by("overlay_id", F.struct("ord", "overlay_id")).alias("overlay_id"), F.sum("n").alias("n_hits"))


def _last_hits(points: pa.Table, overlays: pa.Table) -> pa.Table:
    """point_id, overlay_id, ord of the last overlay that each point hits, and n, the number of overlays it hits."""
    points, overlays = points.combine_chunks(), overlays.combine_chunks()
    pages = pa.concat_arrays([*points["page"].chunks, *overlays["page"].chunks]).dictionary_encode().indices if len(points) + len(overlays) else pa.array([], "int32")
    page, o_page = pages[: len(points)], pages[len(points) :]
    keys = {"page": o_page} | ({"nan": pc.is_nan(overlays["ord"])} if pa.types.is_floating(overlays["ord"].type) else {}) | {"ord": overlays["ord"], "id": overlays["overlay_id"]}
    order = pc.sort_indices(pa.table(keys), sort_keys=[(k, "ascending") for k in keys], null_placement="at_start")
    overlays, o_page = overlays.take(order), o_page.take(order).to_numpy().astype(np.int64)
    page = page.to_numpy().astype(np.int64)
    by_page = np.argsort(page, kind="stable")
    x, y, *edges = (t[c].to_numpy() for t, names in ((points, "x y"), (overlays, "x_from x_to y_from y_to")) for c in names.split())
    n, last = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    for i in range(0, len(points), 8192):
        some = by_page[i : i + 8192]
        rows, first, end = page[some], *np.searchsorted(o_page, [page[some[0]], page[some[-1]] + 1])
        spans = [_spans(rows, v[some], o_page[first:end], lo[first:end], hi[first:end]) for v, lo, hi in ((x, *edges[:2]), (y, *edges[2:]))]
        for j in range(0, end - first, BITS):
            (at_x, in_x), (at_y, in_y) = ((at, _bits(at.max() + 2, start[j : j + BITS], stop[j : j + BITS])) for at, start, stop in spans)
            both = in_x[at_x] & in_y[at_y]
            hit = np.flatnonzero(both.any(axis=1))
            both = both[hit]
            n[some[hit]] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
            word = both.shape[1] - 1 - np.argmax(both[:, ::-1] != 0, axis=1)
            last[some[hit]] = first + j + 32 * word + np.frexp(both[np.arange(len(hit)), word].astype(np.float64))[1] - 1
    found = np.flatnonzero(n)
    best = overlays.take(pa.array(last[found]))
    return pa.table({"point_id": points["point_id"].take(pa.array(found)), "overlay_id": best["overlay_id"], "ord": best["ord"], "n": n[found]})


def _spans(page: np.ndarray, v: np.ndarray, o_page: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of points the place of each (page, v) among the different ones, in order; of overlays the first place from ``lo`` to ``hi`` on their page, and the next after the last."""
    values, rank = np.unique(v, return_inverse=True)
    places, at = np.unique(page * (len(values) + 1) + rank, return_inverse=True)
    start, stop = (np.searchsorted(places, o_page * (len(values) + 1) + np.searchsorted(values, e, side)) for e, side in ((lo, "left"), (hi, "right")))
    return at, start, np.maximum(start, stop)


def _bits(n: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """``n`` rows of bits; bit k is set in the rows from start[k] up to stop[k]."""
    k = np.arange(len(start))
    words = -(-len(start) // 32)
    bits = np.zeros(n * words, np.uint32)
    for row in (start, stop):
        np.bitwise_xor.at(bits, row * words + k // 32, np.uint32(1) << (k % 32).astype(np.uint32))
    return np.bitwise_xor.accumulate(bits.reshape(n, words), axis=0)


def redact(blocks: DataFrame, redactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(blocks left, pages_redacted per document). A page with any area becomes an image: all its text goes."""
    hit = redactions.select(*PAGE).distinct()
    return blocks.join(hit, PAGE, "left_anti"), hit.groupBy("doc_id").agg(F.count("*").alias("pages_redacted"))


def redaction_areas(redactions: DataFrame) -> DataFrame:
    """doc_id, page_index, areas: rectangles of each page, in order of ``ord``."""
    return redactions.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y", "width", "height"))).alias("areas"))


def edit_content(blocks: DataFrame, edits: DataFrame, page_w: float, page_h: float, advance: float = 0.6) -> DataFrame:
    """Blocks (doc_id, page_index, x, y, width, height in page space, text) after ``edits`` (same columns, text, font_size).

    Blocks that begin in an edit's region go; the edit's text comes in its place, in a font size that
    shrinks by half points until the text fits. ``advance``: width of a character at size 1.
    """
    from quillspark.functions.geometry import shrink_font

    kept = remove_in_regions(blocks, edits)
    size = F.coalesce(F.col("font_size"), F.greatest(F.col("height") * 0.85, F.lit(4.0)))
    fitted = shrink_font(size, F.length("text") * advance, F.col("width"))
    added = edits.select(*PAGE, (F.col("x") + 1).alias("x"), (F.col("y") + F.col("height") * 0.15).alias("y"), "width", "height", "text", fitted.alias("font_size"), F.lit(True).alias("added"))
    return kept.select(*PAGE, "x", "y", "width", "height", "text", F.lit(None).cast("double").alias("font_size"), F.lit(False).alias("added")).unionByName(added)


def attach(pages: DataFrame, redactions: DataFrame) -> DataFrame:
    """Every page with its redaction areas; pages without have an empty list."""
    areas = redaction_areas(redactions)
    empty = F.array().cast(areas.schema["areas"].dataType)
    return pages.join(areas, PAGE, "left").withColumn("areas", F.coalesce("areas", empty))


def edits_applied(edits: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, edits_applied: how many edits are of a page that exists."""
    return edits.join(pages.select(*PAGE), PAGE, "left_semi").groupBy("doc_id").agg(F.count("*").alias("edits_applied"))
