"""Quality rules with cross-document line frequency.

Every text gets its base counts inside its own row. Then normalised lines are hashed, the
documents that hold a line are counted per host, lines above the limit are taken out, and a
document that is left with too little is rejected. Built from DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.text import SPACE, columns_of, let, words
from quillspark.scratch import materialize

SYMBOLS = "#*$%&|<>"


def _repeat_words(w: Column) -> Column:
    """Words inside 3-word windows that are found twice or more in the array ``w``."""

    def count(t: Column) -> Column:
        dup = F.filter(
            t,
            lambda x, j: F.coalesce(F.get(t, j - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(t, j + 1)["h"] == x["h"], F.lit(False)),
        )
        at = F.sort_array(F.transform(dup, lambda x: x["p"]))
        start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
        step = lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"))
        return F.aggregate(at, start, step, lambda a: a["n"])

    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    )
    # Most texts repeat no window: distinct hashes settle those without sorting pairs.
    pairs = lambda h: F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    some = F.when(F.size(w) >= 3, let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), let(pairs(h), count)
    ).otherwise(F.lit(0))))
    return F.coalesce(some, F.lit(0)).cast("long")


def _normal(text: Column) -> Column:
    """Lower case, white space inside lines collapsed."""
    return F.regexp_replace(F.lower(text), r"[\x20\x09\x0B-\x0D]+", " ")


def quality_rules(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    line_min_docs: int = 5,
    line_max_share: float = 0.05,
    min_left_share: float = 0.3,
    texts: bool = False,
) -> DataFrame:
    """One row per row of ``docs``: base counts, verdict of the base rules, verdict of the line rule; with ``texts`` also
    ``kept_text``, the text without the lines that are removed.

    A line's limit on a host is ``max(line_min_docs, line_max_share * documents of the host)``; a line
    in more documents than that is removed. A document is depleted when less than ``min_left_share`` of
    its words are left. Copies of one text count as one document, so copies alone never make a
    line frequent.

    Nulls: a null text has no words and fails the base rules; a null host is a host of its own; a null
    id stays null; a null text is kept as an empty one. Lines without a word are never removed. Repeated rows and repeated ids each get their own row. Lines are compared in lower
    case, with white space collapsed and trimmed; lines without a word are ignored. An empty table gives
    an empty table. Extra columns are ignored.

    Lines travel as 64-bit hashes. One host may hold a third of the rows: line counts are
    pre-aggregated on the map side by (host, line).
    """
    columns_of(docs, [id_col, text_col, host_col])
    text = F.coalesce(docs[text_col], F.lit(""))
    flat = _normal(text)
    split = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        docs[id_col].alias("doc_id"),
        docs[host_col].alias("host"),
        text.alias("text"),
        words(text).alias("w"),
        F.filter(F.transform(F.split(flat, "\n"), lambda x: F.trim(x)), lambda x: x != "").alias("norm"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("raw"),
    )
    base = materialize(
        split.select(
            "rid",
            "doc_id",
            "host",
            F.xxhash64("text").alias("text_hash"),
            F.size("w").cast("long").alias("n_words"),
            F.length(F.regexp_replace("text", SPACE + "+", "")).cast("long").alias("word_chars"),
            (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
            _repeat_words(F.col("w")).alias("n_repeat_words"),
            F.transform("norm", lambda x: F.struct(F.xxhash64(x).alias("h"), F.size(F.split(x, " ")).alias("n"))).alias("lines"),
            *(["text"] if texts else []),
        ),
        "quality-rules",
    )

    first = base.groupBy("host", "text_hash").agg(F.min("rid").alias("rid")).select("rid")
    hosts = base.groupBy("host").agg(F.count_distinct("text_hash").alias("docs"))
    limits = hosts.select(
        F.col("host").alias("limit_host"),
        F.greatest(F.lit(float(line_min_docs)), F.col("docs") * F.lit(line_max_share)).alias("most"),
    )
    frequent = (
        base.join(first, "rid", "left_semi")
        .select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
        .groupBy("host", "h")
        .agg(F.count("*").alias("in_docs"))
        .where(F.col("in_docs") > line_min_docs)
    )
    frequent = frequent.join(limits, F.col("host").eqNullSafe(F.col("limit_host"))).where("in_docs > most").select(
        F.col("host").alias("f_host"), F.col("h").alias("f_h")
    )
    frequent = materialize(frequent, "frequent-lines")  # so that the join deals rows anew and can divide a line that many have
    removed = (
        base.select("rid", "host", F.explode("lines").alias("line"))
        .join(frequent, F.col("host").eqNullSafe(F.col("f_host")) & (F.col("line.h") == F.col("f_h")))
        .groupBy("rid")
        .agg(F.sum("line.n").alias("n_removed"), *([F.collect_set("line.h").alias("gone")] if texts else []))
    )
    n, cut = F.col("n_words"), F.coalesce(F.col("n_removed"), F.lit(0)).cast("long")
    failed = (n < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * n)
    left_over = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains("gone", F.xxhash64(F.trim(_normal(x)))))
    kept_text = [F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(left_over, "\n")).alias("kept_text")] if texts else []
    return base.join(removed, "rid", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ((n - cut) >= n * F.lit(min_left_share))).alias("kept"),
        cut.alias("n_line_words_removed"),
        *kept_text,
    )
