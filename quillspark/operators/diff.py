"""Word-level comparison of two document versions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.functions.strings import fuzzy_ratio

PAIR = ["pair_id", "page_index"]


def align_pages(first: DataFrame, second: DataFrame) -> DataFrame:
    """Positional full outer join of two versions' pages (pair_id, page_index, words); -1 where a side has no page."""
    a = first.select("pair_id", "page_index", F.col("words").alias("old"), F.lit(True).alias("in1"))
    b = second.select("pair_id", "page_index", F.col("words").alias("new"), F.lit(True).alias("in2"))
    none = F.array().cast("array<string>")
    side = lambda flag: F.when(F.col(flag), F.col("page_index")).otherwise(-1).alias
    return a.join(b, PAIR, "full_outer").select(
        *PAIR, side("in1")("page_index1"), side("in2")("page_index2"), F.coalesce("old", none).alias("old"), F.coalesce("new", none).alias("new")
    )


def lcs_ops(old: list[str], new: list[str]) -> list[tuple[str, int, int]]:
    """(op, old index, new index) in order: E equal, D delete, I insert; -1 for the side that an op lacks.

    Words match without regard to case. Of the longest common subsequences the one is taken that a walk
    back from the end finds, matching where it can, else inserting where that loses nothing. Row by row,
    a cell costs one vector step and one bit.
    """
    a, b = [w.lower() for w in old], [w.lower() for w in new]
    tail = 0
    while tail < len(a) and tail < len(b) and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    m, n = len(a) - tail, len(b) - tail
    ids: dict[str, int] = {}
    x = np.array([ids.setdefault(w, len(ids)) for w in a[:m]], dtype=np.int64)
    y = np.array([ids.setdefault(w, len(ids)) for w in b[:n]], dtype=np.int64)
    prev = np.zeros(n + 1, dtype=np.int32)
    insert = []
    for i in range(m):
        row = np.zeros(n + 1, dtype=np.int32)
        np.maximum.accumulate(np.where(y == x[i], prev[:-1] + 1, prev[1:]), out=row[1:])
        insert.append(np.packbits(row[:-1] >= prev[1:]))
        prev = row
    ops = [("E", len(a) - 1 - t, len(b) - 1 - t) for t in range(tail)]
    i, j = m, n
    while i or j:
        if i and j and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            ops.append(("E", i, j))
        elif j and (not i or insert[i - 1][(j - 1) >> 3] >> (7 - ((j - 1) & 7)) & 1):
            j -= 1
            ops.append(("I", -1, j))
        else:
            i -= 1
            ops.append(("D", i, -1))
    return ops[::-1]


def diff_ops(aligned: DataFrame) -> DataFrame:
    """pair_id, page_index, page_index1, page_index2, op_seq, op (E, D, I), old_text, new_text from aligned pages."""
    schema = "pair_id bigint, page_index int, page_index1 int, page_index2 int, op_seq int, op string, old_text string, new_text string"
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                old, new = r["old"], r["new"]
                ops = lcs_ops(old, new)
                k = len(ops)
                if not k:
                    continue
                cols = [[r[c]] * k for c in names[:4]] + [range(k), [o for o, _, _ in ops], [old[i] if i >= 0 else None for _, i, _ in ops], [new[j] if j >= 0 else None for _, _, j in ops]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return aligned.select(F.col("pair_id").cast("bigint").alias("pair_id"), F.col("page_index").cast("int").alias("page_index"), F.col("page_index1").cast("int").alias("page_index1"), F.col("page_index2").cast("int").alias("page_index2"), "old", "new").mapInArrow(run, schema)


def merge_changes(ops: DataFrame, least: float = 0.8) -> DataFrame:
    """``ops`` with deletes and inserts that belong together marked C (change), in both their rows.

    Between two equal words the deletes come first, then the inserts. The t-th delete and the t-th
    insert are a change as long as this pair and all before it are more alike than ``least``.
    """
    order = Window.partitionBy(*PAIR).orderBy("op_seq")
    o = ops.withColumn("gap", F.sum((F.col("op") == "E").cast("int")).over(order))
    o = o.withColumn("ordinal", F.row_number().over(Window.partitionBy(*PAIR, "gap", "op").orderBy("op_seq")))
    slot = Window.partitionBy(*PAIR, "gap", "ordinal")
    old = F.max(F.when(F.col("op") == "D", F.col("old_text"))).over(slot)
    new = F.max(F.when(F.col("op") == "I", F.col("new_text"))).over(slot)
    o = o.withColumn("alike", F.coalesce(fuzzy_ratio(old, new) > least, F.lit(False)))
    so_far = Window.partitionBy(*PAIR, "gap").orderBy("ordinal").rangeBetween(Window.unboundedPreceding, 0)
    changed = (F.col("op") != "E") & F.min(F.when(F.col("op") != "E", F.col("alike")).otherwise(True)).over(so_far)
    return o.withColumn("op", F.when(changed, "C").otherwise(F.col("op"))).drop("gap", "ordinal", "alike")


def change_counts(merged: DataFrame) -> DataFrame:
    """pair_id, page_index1, page_index2, added, deleted, changed per page that has words."""
    count = lambda c: F.count_if(c).cast("bigint")
    return merged.groupBy("pair_id", "page_index1", "page_index2").agg(
        count(F.col("op") == "I").alias("added"), count(F.col("op") == "D").alias("deleted"),
        count((F.col("op") == "C") & F.col("new_text").isNotNull()).alias("changed"),
    )


def compare(first: DataFrame, second: DataFrame) -> DataFrame:
    """Change counts per page of two versions (pair_id, page_index, words)."""
    return change_counts(merge_changes(diff_ops(align_pages(first, second))))
