"""Mixing sources to target weights by entropy balancing.

Every source has a token constraint: the sum of rate times size over its documents is its target. Of all rates
from 0 to ``max_copies`` that meet it, those nearest to the prior rates, by relative entropy summed over the
documents, are exponential tilts, rate = min(max_copies, prior * exp(lambda * size / scale)) with a lambda for
each source: size is the constraint's coefficient, so a source that must give more words leans to long documents and
one that must give fewer to short ones. The lambdas solve the convex dual. Newton's steps need its gradient and
its slope, a sum each over the documents; they are aggregations over (source, prior, size) counts, in
decimals, so that no order of summing changes a bit. A step that leaves the bracket that is known to hold
the solution is replaced by its middle. Rates are then rounded to whole copies so that every source's error
stays small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.ranks import size_class, sorted_rank, spread_rank
from quillspark.llm.text import columns_of, word_count
from quillspark.scratch import discard, materialize

SUM = "decimal(38,9)"


def source_targets(sizes: DataFrame, weights: list[float], max_copies: int) -> DataFrame:
    """source, source_size, target for (source, source_size), sources by code point, null last.

    All sizes are shared by weight; a target stops at ``max_copies`` times its source, and what is over
    goes to the others by weight until no target is above.
    """
    order = [F.col("source").isNull().asc(), F.col("source").asc()]
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialize(sorted_rank(sizes, order, "rank").select("source", "source_size", weight.alias("w")), "sources")
    full = F.col("source_size") * max_copies
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    left, level = float(total), 0.0
    capped = -1
    while True:
        at = F.col("w") * F.lit(level) >= full
        got = ranked.agg(F.count_if(at).alias("n"), F.sum(F.when(at, full)).alias("full"), F.sum(F.when(~at, F.col("w"))).alias("w")).first()
        if got["n"] == capped or not got["w"]:
            break
        capped, left = got["n"], float(total - (got["full"] or 0))
        level = left / got["w"]
    return ranked.select("source", "source_size", F.least(F.col("w") * F.lit(level), full.cast("double")).alias("target"))


def _exact_sum(c: Column) -> Column:
    """A sum that does not hang on the order of its rows."""
    return F.sum(c.cast(SUM)).cast("double")


def newton_tilts(groups: DataFrame, targets: DataFrame, max_copies: int, tolerance: float = 1e-9, steps: int = 100) -> DataFrame:
    """key, scale, lam: the dual's solution for groups (key, prior, size, n; prior and size over 0) and targets (key, target).

    A source whose target is zero, or that has no such group, has a null lam.
    """
    cap, prior, size, n = float(max_copies), F.col("prior"), F.col("size"), F.col("n")
    whole = groups.groupBy("key").agg(
        F.sum(F.col("n") * F.col("size")).cast("double").alias("words"),
        _exact_sum(n * size * size.cast("double")).alias("squares"),
        _exact_sum(prior * size * n).alias("asked"),
        F.min("size").cast("double").alias("least"),
        F.max(F.ln(F.lit(cap) / prior) / size).alias("top"),
    )
    low = F.least(F.lit(0.0), F.ln(F.col("target") / F.col("asked")) / F.col("least")) * F.col("scale")
    start = targets.where("target > 0").join(whole, "key").withColumn("scale", F.col("squares") / F.col("words"))
    start = start.select("key", "target", "scale", low.alias("lo"), (F.col("top") * F.col("scale")).alias("hi"), (F.col("target") >= cap * F.col("words")).alias("full"))
    inside = F.greatest(F.col("lo"), F.least(F.col("hi"), F.lit(0.0)))
    start = start.withColumn("lo", F.least("lo", "hi"))
    state = materialize(start.withColumn("lam", F.when(F.col("full"), F.col("hi")).otherwise(inside)).drop("full"), "tilts")
    for _ in range(steps):
        log_rate = F.ln(prior) + F.col("lam") * size / F.col("scale")
        free = log_rate < F.ln(F.lit(cap))
        taken = n * size * F.when(free, F.exp(log_rate)).otherwise(F.lit(cap))
        slope = F.when(free, n * size * F.exp(log_rate) * size / F.col("scale")).otherwise(F.lit(0.0))
        sums = groups.join(state, "key").groupBy("key").agg(
            *(F.first(c).alias(c) for c in ("target", "scale", "lo", "hi", "lam")), _exact_sum(taken).alias("f"), _exact_sum(slope).alias("h")
        )
        over = F.col("f") > F.col("target")
        sums = sums.withColumn("lo", F.when(over, F.col("lo")).otherwise(F.greatest("lo", "lam"))).withColumn("hi", F.when(over, F.least("hi", "lam")).otherwise(F.col("hi")))
        newton = F.col("lam") + F.try_divide(F.col("target") - F.col("f"), F.col("h"))
        held = F.coalesce((newton > F.col("lo")) & (newton < F.col("hi")), F.lit(False))
        off = (F.abs(F.col("f") - F.col("target")) > F.col("target") * tolerance) & (F.col("hi") - F.col("lo") > 1e-13 * F.greatest(F.lit(1.0), F.abs("lam")))
        lam = F.when(~off, F.col("lam")).when(held, newton).otherwise((F.col("lo") + F.col("hi")) / 2)
        moved = materialize(sums.select("key", "target", "scale", "lo", "hi", lam.alias("lam"), off.alias("off")), "tilts")
        discard(state)
        state = moved.drop("off")
        state._quillspark_path = moved._quillspark_path
        if not moved.where("off").limit(1).count():
            break
    return state.select("key", "scale", "lam")


def _copies(sized: DataFrame, rows: int) -> DataFrame:
    """rid, copies. ``sized``: rid, doc_id, key, size, h, rate.

    The whole part of a rate is taken as it is. Of the fractions, each class of like sizes in a source
    takes as many documents as bring the running sum, from large sizes to small, nearest to what the
    rates ask for; which ones, a hash of the document says.
    """
    whole = F.floor(F.col("rate") + 1e-9).cast("int")
    frac = F.greatest(F.col("rate") - whole, F.lit(0.0))
    d = sized.select("rid", "doc_id", "key", "size", "h", whole.alias("whole"), F.when(F.col("size") > 0, frac).otherwise(0.0).alias("frac"))
    d = d.withColumn("cls", size_class(F.col("size")) * 16 + F.floor(F.col("frac") * 15.999).cast("int"))
    classes = d.where("frac > 0").groupBy("key", "cls").agg(
        F.count("*").alias("n"), F.avg("size").alias("mean"), _exact_sum(F.col("frac") * F.col("size")).alias("want")
    )
    row = F.struct(F.col("mean"), F.col("cls"), F.col("n"), F.col("want"))
    lists = classes.groupBy("key").agg(F.sort_array(F.collect_list(row), asc=False).alias("cs"))
    start = F.struct(F.lit(0.0).alias("err"), F.array().cast("array<struct<cls:int,k:bigint>>").alias("out"))

    def step(a: Column, c: Column) -> Column:
        goal = a["err"] + c["want"]
        k = F.greatest(F.lit(0), F.least(c["n"], F.round(goal / c["mean"]).cast("bigint")))
        return F.struct((goal - k * c["mean"]).alias("err"), F.concat(a["out"], F.array(F.struct(c["cls"].alias("cls"), k.alias("k")))).alias("out"))

    quotas = lists.select("key", F.explode(F.aggregate("cs", start, step, lambda a: a["out"])).alias("q")).select("key", "q.cls", "q.k")
    ranked = spread_rank(d.where("frac > 0"), ["key", "cls"], F.col("h"), ["h", "doc_id", "size"], "rank", rows)
    more = ranked.join(quotas, ["key", "cls"]).where("rank < k").select("rid", F.lit(1).alias("extra"))
    return d.join(more, "rid", "left").select("rid", (F.col("whole") + F.coalesce("extra", F.lit(0))).cast("int").alias("copies"))


def mix_sources(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", prior_col: str | None = None,
    weights: list[float] | None = None, max_copies: int = 3, carry: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every row of ``docs``; with ``carry``, its columns as c0, c1, ... and _copies.

    Size is the number of words; a null text has none and is taken neither more nor less. A null source is a
    source of its own, the last. Null ids take part like others; repeated rows are rows of their own,
    and which of them gets a copy makes no difference to the result. ``prior_col`` (default 1
    everywhere; null or negative: 0) is the rate that a document would have without constraints. An empty table gives an empty table.

    A source's taken words differ from its target by rounding only. Choices hang on hashes of id and text, so
    reruns agree. One source may hold a third of the rows: sums are pre-aggregated, ranks are spread over buckets.
    """
    columns_of(docs, [id_col, text_col, source_col, *([prior_col] if prior_col else [])])
    names = list(docs.columns)
    prior = F.greatest(F.coalesce(docs[prior_col].cast("double"), F.lit(0.0)), F.lit(0.0)) if prior_col else F.lit(1.0)
    sized = materialize(
        docs.select(
            F.monotonically_increasing_id().alias("rid"),
            docs[id_col].alias("doc_id"),
            docs[source_col].alias("source"),
            word_count(docs[text_col]).alias("size"),
            prior.alias("prior"),
            F.xxhash64(docs[id_col], docs[text_col]).alias("h"),
            *((docs[c].alias(f"c{i}") for i, c in enumerate(names)) if carry else ()),
        ),
        "sizes",
    )
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("key")
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights or [1.0, 2.0, 3.0], max_copies)
    targets = materialize(targets.select(key, "source_size", "target"), "targets")
    groups = materialize(sized.where("size > 0 AND prior > 0").groupBy(key, "prior", "size").agg(F.count("*").alias("n")), "size-counts")
    lams = newton_tilts(groups, targets, max_copies)
    discard(groups)
    tilts = materialize(targets.join(lams, "key", "left"), "target-tilts")
    rated = sized.select("rid", "doc_id", key, "size", "prior", "h").join(tilts, "key")
    cap = F.lit(float(max_copies))
    tilted = F.when(F.col("prior") > 0, F.least(F.ln("prior") + F.col("lam") * F.col("size") / F.col("scale"), F.ln(cap)))
    rate = F.when((F.col("target") > 0) & (F.col("size") > 0), F.least(F.exp(tilted), cap)).otherwise(0.0)
    # A source without words asks for nothing: its documents stay as their priors say.
    rate = F.when(F.col("size") == 0, F.least(F.col("prior"), cap)).otherwise(F.coalesce(rate, F.lit(0.0)))
    copies = _copies(rated.select("rid", "doc_id", "key", "size", "h", rate.alias("rate")), sized.count())
    if carry:
        return sized.join(copies, "rid").select(*(f"c{i}" for i in range(len(names))), F.col("copies").alias("_copies"))
    return sized.select("rid", "doc_id", key, "size").join(targets, "key").join(copies, "rid").select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken")
    )


def take_mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Columns, nulls, ties and repeated rows are as in :func:`mix_sources`; a document without words is taken once (or as often
    as its prior says). An empty table gives an empty table; columns of any name are kept as they are.
    """
    mixed = mix_sources(docs, carry=True, **options)
    each = mixed.select("*", F.explode(F.array_repeat(F.lit(1), F.col("_copies"))))
    return each.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
