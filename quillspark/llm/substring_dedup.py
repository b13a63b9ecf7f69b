"""Substring dedup: words inside long windows that an earlier document has too.

A window is ``width`` words in a row. Windows are compared in two steps that lose none:

1. Every window has a minimizer, the least hash among its ``gram``-word pieces; equal windows have equal
   ones. Windows in a row with one minimizer are a run, of ``LONGEST`` windows at most. Runs, about one for 20
   words, are what is shuffled. A minimizer that one document alone has settles its windows.
2. A run whose whole word sequence starts in an earlier document too is removed whole. What remains are runs at
   the edges of shared passages: of each different one the first document's windows are compared
   one by one.

Word sequences are compared by two independent 64-bit hashes, sums of word hashes times powers of odd bases modulo 2**64.
Such sums are weak for sequences of thousands of words that are alike in a certain way; runs are
shorter, which is what their bound is for. Counts are pre-aggregated, so a passage
that a third of the documents share costs a row per task, and nothing is collected per passage.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from quillspark.llm.text import columns_of
from quillspark.scratch import discard, materialize

BASES = (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4D | 5)
MIX = np.uint64(0xFF51AFD7ED558CCD)
RUNS = "doc {}, t bigint, mz bigint, r1 bigint, r2 bigint, s0 int, n int"
LONGEST = 256
RUN_FIELDS = ("doc", "t", "mz", "r1", "r2", "s0", "n")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * MIX
    return x ^ (x >> np.uint64(29))


class Sequence:
    """Hashes of any stretch of a text's words, by prefix sums modulo 2**64."""

    def __init__(self, words: list[bytes]) -> None:
        h = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
        self.sums, self.powers = [], []
        for i, base in enumerate(BASES):
            n = len(words)
            power, inverse = np.ones(n + 1, dtype=np.uint64), np.ones(n + 1, dtype=np.uint64)
            power[1:], inverse[1:] = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
            power, inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
            sums = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((h if i == 0 else _mix(h)) * inverse[:n], out=sums[1:])
            self.sums.append(sums)
            self.powers.append(power)

    def hashes(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        s = self.sums[which]
        return _mix((s[stop] - s[start]) * self.powers[which][start])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every ``w`` values in a row, by doubling."""
    span = 1
    while 2 * span <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = w - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def runs_of(words: list[bytes], width: int, gram: int) -> tuple[np.ndarray, ...] | None:
    """mz, r1, r2, first window, number of windows of each run; None for a text without a window."""
    n = len(words) - width + 1
    if n < 1:
        return None
    q = Sequence(words)
    at = np.arange(len(words) - gram + 1)
    least = _sliding_min(q.hashes(0, at, at + gram), width - gram + 1)
    s0 = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    count = np.diff(np.append(s0, n))
    if count.max() > LONGEST:  # a text that repeats itself
        parts = -(-count // LONGEST)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        s0 = np.repeat(s0, parts) + step * LONGEST
        count = np.diff(np.append(s0, n))
    stop = s0 + count + width - 1
    return least[s0], q.hashes(0, s0, stop), q.hashes(1, s0, stop), s0, count


def _words(body: pa.Scalar) -> list[bytes]:
    return (body.as_py() or b"").split()


def dedup_substrings(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 50, gram: int = 12, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row, with ``texts`` also the kept words as ``kept_text``.

    A word goes when a window that covers it also starts in a document with a smaller id; windows are judged on
    the input. A null text has no words. A row without id is neither earlier nor later than any: it keeps
    all words. Ids may be of any type that has an order. Rows that repeat an id don't count as earlier than each other. An empty table gives an empty
    table; extra columns are ignored.
    """
    columns_of(docs, [id_col, text_col])
    named = docs.select(docs[id_col].alias("doc"), F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8").alias("body"))
    named = named.withColumn("t", F.xxhash64("body"))
    kind = named.schema["doc"].dataType.simpleString()

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            rows = 0
            for doc, body, t in zip(*batch.columns, strict=True):
                got = runs_of(_words(body), width, gram)
                if got is None:
                    continue
                k = len(got[0])
                held.append((pa.repeat(doc, k), np.full(k, t.as_py()), *(x.view(np.int64) for x in got[:3]), *got[3:]))
                rows += k
                if rows > 100_000:
                    yield _batch(held)
                    held, rows = [], 0
            if held:
                yield _batch(held)

    def _batch(held: list[tuple]) -> pa.RecordBatch:
        ids, *rest = zip(*held, strict=True)
        cols = [np.concatenate(c) for c in rest]
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), *(pa.array(c.astype(np.int32 if i > 3 else np.int64)) for i, c in enumerate(cols))], names=RUN_FIELDS)

    runs = materialize(named.where("doc IS NOT NULL").select("doc", "body", "t").mapInArrow(find, RUNS.format(kind)), "runs")
    # Keys are written before they are joined, so that the join deals rows anew and can divide a key that many have.
    shared = materialize(runs.groupBy("mz").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("mz"), "shared-minimizers")
    cand = materialize(runs.join(shared, "mz"), "shared-runs")
    discard(runs)
    discard(shared)
    place = F.struct("doc", "t", "s0")
    firsts = materialize(cand.groupBy("r1", "r2").agg(F.min(place).alias("p"), F.first("mz").alias("mz"), F.first("n").alias("n"), F.max("doc").alias("hi")), "first-runs")
    whole = cand.join(firsts.where("p.doc < hi").select("r1", "r2", F.col("p.doc").alias("d0")), ["r1", "r2"]).where("doc > d0")
    whole = whole.select("doc", "t", F.col("s0").alias("a"), (F.col("s0") + F.col("n") - 1).alias("b"))

    open_ = materialize(firsts.groupBy("mz").agg(F.min("p.doc").alias("lo"), F.max("p.doc").alias("hi")).where("lo < hi").select("mz"), "open-minimizers")
    asked = firsts.join(open_, "mz", "left_semi").groupBy(F.col("p.doc").alias("doc"), F.col("p.t").alias("t")).agg(
        F.collect_list(F.struct("r1", "r2", F.col("p.s0").alias("s0"), "n")).alias("runs")
    )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["w1", "w2", "r1", "r2", "off", "doc"]
        for batch in batches:
            for doc, body, wanted in zip(*batch.columns, strict=True):
                q = Sequence(_words(body))
                parts = []
                for r in wanted.as_py():
                    at = np.arange(r["s0"], r["s0"] + r["n"])
                    parts.append((q.hashes(0, at, at + width).view(np.int64), q.hashes(1, at, at + width).view(np.int64), np.full(r["n"], r["r1"]), np.full(r["n"], r["r2"]), (at - r["s0"]).astype(np.int32)))
                cols = [np.concatenate(c) for c in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.repeat(doc, len(cols[0]))], names=names)

    windows = named.join(asked, ["doc", "t"]).select("doc", "body", "runs")
    windows = materialize(windows.mapInArrow(spread, f"w1 bigint, w2 bigint, r1 bigint, r2 bigint, off int, doc {kind}"), "windows")
    earlier = windows.groupBy("w1", "w2").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
    earlier = materialize(earlier, "shared-windows")
    hit = windows.join(earlier, ["w1", "w2"]).where("doc > lo").select("r1", "r2", "off", F.col("doc").alias("d0")).distinct()
    single = cand.join(hit, ["r1", "r2"]).where("doc = d0").select("doc", "t", (F.col("s0") + F.col("off")).alias("a"), (F.col("s0") + F.col("off")).alias("b"))
    spans = whole.unionByName(single).groupBy("doc", "t").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    spans = materialize(spans, "spans")
    for x in (windows, earlier, firsts, cand, open_):
        discard(x)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for body, a, b in zip(*batch.columns[1:], strict=True):
                w = _words(body)
                n = len(w)
                if a.is_valid:
                    edge = np.zeros(n + 1, dtype=np.int64)
                    np.add.at(edge, a.values.to_numpy(), 1)
                    np.add.at(edge, b.values.to_numpy() + width, -1)
                    w = [x for x, hidden in zip(w, (np.cumsum(edge[:n]) > 0).tolist(), strict=True) if not hidden]
                kept = b" ".join(w)
                out.append((n, n - len(w), hashlib.sha256(kept).hexdigest(), kept.decode() if texts else None))
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            types = (pa.int64(), pa.int64(), pa.string(), pa.string())
            arrays = [batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    done = named.join(spans, ["doc", "t"], "left").select("doc", "body", "a", "b")
    done = done.mapInArrow(cut, f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    return done if texts else done.drop("kept_text")
