"""Benchmark decontamination by SimHash over item-sized windows, with DataFrame functions only.

1. Windows. A window as long as an item that is similar to it by ``similarity`` has at least one of
   any of the item's shingles that together weigh more than ``1 - similarity`` of it. Such anchors, the
   rarest in the benchmark's different texts, are looked up among the documents' shingles; each hit sets a window for
   its item at every start from which an item-sized window covers it. No similar window is lost here, in
   whatever order it has the item's parts.
2. Fingerprints. Each window's SimHash is looked up among those of the items that set it, in a multi-index of
   radius + 1 blocks of bits: two fingerprints within the radius share a block.
3. Verification. What is within the radius is compared exactly, by weighted Jaccard over shingles,
   each shingle weighing as often as it occurs.

At similarity 0.8 about 10 of 64 bits differ, with a standard deviation of 3, and more where there are few
shingles to vote. The radius is therefore ``radius`` bits for items of ``few`` shingles or more and
``radius_few`` for shorter ones, five standard deviations out in both cases. So wide a radius makes blocks of two or
three bits, which part few fingerprints: it is the anchors that keep lookups few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.text import columns_of, let, words
from quillspark.scratch import materialize

STRETCH = 4096


def _key(docs: DataFrame, id_col: str, text_col: str) -> Column:
    return F.xxhash64(docs[id_col], docs[text_col])


def _shingles(w: Column, first: Column, last: Column, width: int) -> Column:
    """Hashes of the shingles of ``w`` that start at ``first`` to ``last``; empty if there are none."""
    made = F.transform(F.sequence(first, last), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(width))))
    return F.when(last >= first, made).otherwise(F.array().cast("array<bigint>"))


def _any_width(w: Column, first: Column, n: Column, width: Column, widest: int) -> Column:
    """Shingles of the ``n`` words of ``w`` from ``first`` on, of a width that a column says."""
    out = _shingles(w, first, first + n - widest, widest)
    for k in range(widest - 1, 0, -1):
        out = F.when(width == k, _shingles(w, first, first + n - k, k)).otherwise(out)
    return out


def _simhash(hashes: Column) -> Column:
    """A bit is one where it is one in over half the hashes.

    Four bits are counted at a time, in lanes of 16 bits; more hashes than a lane can count are counted bit by bit.
    """
    lanes = F.lit(0x0001000100010001)
    count = lambda j: F.aggregate(hashes, F.lit(0).cast("bigint"), lambda s, h: s + F.shiftrightunsigned(h, j).bitwiseAND(lanes))
    sums = [count(j) for j in range(16)]

    def put(n: Column) -> Column:
        out = F.lit(0).cast("bigint")
        for j, c in enumerate(sums):
            for lane in range(4):
                ones = F.shiftrightunsigned(c, 16 * lane).bitwiseAND(F.lit(0xFFFF))
                bit = j + 16 * lane
                one = F.lit((1 << bit) - ((1 << 64) if bit == 63 else 0)).cast("bigint")
                out = out.bitwiseOR(F.when(ones * 2 > n, one).otherwise(F.lit(0).cast("bigint")))
        return out

    bit = lambda b: F.size(F.filter(hashes, lambda h: F.getbit(h, b) == 1)) * 2 > F.size(hashes)
    slow = lambda a, b: a.bitwiseOR(F.when(bit(b), F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint")))
    return F.when(F.size(hashes) < 1 << 16, put(F.size(hashes))).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), slow))


def _blocks(fp: Column, radius: int) -> Column:
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    cut = lambda a, b: F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint"))
    return F.array(*(F.struct(F.lit(i).alias("no"), cut(a, b).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:]))))


def _common(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    both = F.array_intersect(a, b)
    times = lambda xs, h: F.size(F.filter(xs, lambda x: x == h))
    counted = let(both, lambda c: F.aggregate(c, F.lit(0), lambda s, h: s + F.least(times(a, h), times(b, h))))
    plain = (F.size(F.array_distinct(a)) == F.size(a)) | (F.size(F.array_distinct(b)) == F.size(b))
    return F.when(plain, F.size(both)).otherwise(counted)


def contaminated(
    docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    width: int = 5, similarity: float = 0.8, radius: int = 24, radius_few: int = 28, few: int = 9, broadcast_rows: int = 500_000,
) -> DataFrame:
    """doc_id, item_id, first_word, n_words, hamming, similarity: the best window for each document and item that match; row_key tells rows apart.

    Texts are compared in lower case by words. Items under ``width`` words have one shingle, all their
    words; items without words or id match nothing, as do null and empty documents. A window is cut at the
    document's ends. Null document ids are reported as null; rows that agree in id and text are reported
    once; ties go to the first window. Empty tables give an empty table; extra columns are ignored.
    Anchors and index are broadcast if they have at most ``broadcast_rows`` rows, else joined by shuffle.
    """
    columns_of(docs, [id_col, text_col])
    columns_of(benchmark, [item_col, item_text_col])
    lower = words(F.lower(benchmark[item_text_col]))
    items = benchmark.where(benchmark[item_col].isNotNull()).select(benchmark[item_col].alias("item_id"), lower.alias("w")).where("size(w) > 0")
    items = items.groupBy("w").agg(F.collect_set("item_id").alias("ids")).withColumn("item", F.monotonically_increasing_id())
    items = items.select("item", "ids", "w", F.size("w").alias("len"), F.least(F.size("w"), F.lit(width)).alias("k"))
    items = items.select("item", "ids", "len", "k", _any_width(F.col("w"), F.lit(0), F.col("len"), F.col("k"), width).alias("hs"))
    items = materialize(items.select("*", let(F.col("hs"), _simhash).alias("fp")), "items")

    shingles = items.select("item", "len", "k", F.size("hs").alias("weight"), F.explode("hs").alias("h"))
    counts = shingles.groupBy("item", "len", "k", "weight", "h").agg(F.count("*").alias("c"))
    common = counts.groupBy("h").agg(F.count("*").alias("in_items"))
    rarest = Window.partitionBy("item").orderBy("in_items", "h").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("c").over(rarest), F.lit(0))
    least = F.ceil(F.col("weight") * similarity - 1e-9)  # shingles that a similar window shares at least
    anchors = counts.join(common, "h").withColumn("before", before).where(F.col("before") <= F.col("weight") - least)
    anchors = materialize(anchors.select("h", "item", "k", "len"), "anchors")
    small = anchors.count() <= broadcast_rows
    widths = sorted(r["k"] for r in anchors.select("k").distinct().collect()) or [width]

    named = docs.select(docs[id_col].alias("doc_id"), _key(docs, id_col, text_col).alias("row_key"), F.lower(docs[text_col]).alias("t"))
    cut = named.select("row_key", words(F.col("t")).alias("w"))
    hits = None
    for k in widths:
        at = cut.select("row_key", F.posexplode(_shingles(F.col("w"), F.lit(0), F.size("w") - k, k)).alias("p", "h"))
        with_k = anchors.where(F.col("k") == k).select("h", "item", "len")
        got = at.join(F.broadcast(with_k) if small else with_k, "h").select("row_key", "item", "len", F.lit(k).alias("k"), "p", F.floor(F.col("p") / STRETCH).cast("int").alias("part"))
        hits = got if hits is None else hits.unionAll(got)
    # A long document's hits are taken in stretches, so that no row grows with the square of its length.
    asked = hits.groupBy("row_key", "item", "len", "k", "part").agg(F.sort_array(F.collect_set("p")).alias("ps"))
    # Starts that cover a hit, less those that cover the one before: ranges without overlap.
    ranges = F.transform("ps", lambda p, i: F.struct(F.greatest(p - F.col("len") + F.col("k"), F.get("ps", i - 1) + 1).alias("a"), p.alias("z")))
    asked = materialize(asked.groupBy("row_key").agg(F.collect_list(F.struct("item", "len", "k", "part", ranges.alias("ranges"))).alias("regions")), "windows")

    if asked.count() <= broadcast_rows:  # then texts without a hit don't travel
        named = named.join(F.broadcast(asked.select("row_key")), "row_key", "left_semi")
    found = named.join(asked, "row_key").select("doc_id", "row_key", words(F.col("t")).alias("w"), "regions")
    found = found.select("doc_id", "row_key", "w", F.size("w").alias("n"), F.explode("regions").alias("x")).select("doc_id", "row_key", "w", "n", "x.*")
    base = F.greatest(F.col("part") * STRETCH - F.col("len") + F.col("k"), F.lit(0))
    stop = F.least(F.col("n"), (F.col("part") + 1) * STRETCH + F.col("len"))
    found = found.withColumn("base", base).withColumn("hs", _any_width(F.col("w"), base, stop - base, F.col("k"), width)).drop("w")
    found = found.select("doc_id", "row_key", "item", "len", "k", "n", "base", "hs", F.explode("ranges").alias("r"))
    near_r = F.greatest(F.col("r.a"), F.lit(0))
    slim = F.slice("hs", near_r - F.col("base") + 1, F.col("r.z") + F.col("len") - F.col("k") + 1 - near_r)
    found = found.select("doc_id", "row_key", "item", "len", "k", "n", near_r.alias("base"), slim.alias("hs"), "r")
    found = found.select("doc_id", "row_key", "item", "len", "k", "n", "base", "hs", F.explode(F.sequence("r.a", "r.z")).alias("at"))
    begin = F.greatest(F.col("at"), F.lit(0))
    n_words = F.least(F.col("at") + F.col("len"), F.col("n")) - begin
    found = found.select("doc_id", "row_key", "item", begin.alias("first_word"), n_words.alias("n_words"), F.slice("hs", begin - F.col("base") + 1, n_words - F.col("k") + 1).alias("ws"))
    found = materialize(found.withColumn("wfp", let(F.col("ws"), _simhash)), "window-fingerprints")

    sized = items.select("item", "fp", F.size("hs").alias("weight"))
    blocks = lambda fp: F.when(F.col("weight") >= few, _blocks(fp, radius)).otherwise(_blocks(fp, radius_few))
    index = materialize(sized.select("item", "fp", "weight", F.explode(blocks(F.col("fp"))).alias("b")).select("item", "fp", "weight", "b.no", "b.bits"), "index")
    light = index.count() <= broadcast_rows
    spread = F.broadcast if light else (lambda df: df)
    probes = found.select("item", "wfp").distinct().join(spread(sized.select("item", "weight")), "item")
    probes = probes.select("item", "wfp", F.explode(blocks(F.col("wfp"))).alias("b")).select("item", "wfp", "b.no", "b.bits")
    pairs = probes.join(spread(index), ["item", "no", "bits"])
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("wfp")))
    within = F.when(F.col("weight") >= few, F.lit(radius)).otherwise(F.lit(radius_few))
    near = materialize(pairs.withColumn("hamming", apart).where(F.col("hamming") <= within).select("item", "wfp", "hamming").distinct(), "near")
    near = found.join(near, ["item", "wfp"]).join(spread(items.select("item", "ids", "hs")), "item")
    m = _common(F.col("hs"), F.col("ws"))
    scored = near.withColumn("m", m).withColumn("similarity", F.col("m") / (F.size("hs") + F.size("ws") - F.col("m"))).where(F.col("similarity") >= similarity)
    best = F.max_by(F.struct("first_word", "n_words", "hamming", "similarity"), F.struct("similarity", -F.col("first_word"))).alias("x")
    scored = scored.withColumn("item_id", F.explode("ids"))
    return scored.groupBy("doc_id", "row_key", "item_id").agg(best).select("doc_id", "item_id", "x.first_word", "x.n_words", "x.hamming", "x.similarity", "row_key")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that match no item, with all their columns, whatever they are called.

    Rows with a null or empty text match nothing and stay; of repeated rows all go or all stay; empty tables give
    an empty table or all of ``docs``.
    """
    bad = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("row_key").alias("_bad"), F.col("doc_id").alias("_bad_id")).distinct()
    bad = materialize(bad, "contaminated")
    same = (_key(docs, id_col, text_col) == bad["_bad"]) & docs[id_col].eqNullSafe(bad["_bad_id"])
    return docs.join(bad, same, "left_anti")
