"""Near-duplicates by SimHash and a binary-trie self-join.

Fingerprints that differ in at most ``budget`` bits are linked. Equal fingerprints are one node.
With ``budget + r`` blocks of bits, two linked fingerprints agree on at least ``r`` whole blocks, so for
each choice of ``r`` blocks the fingerprints that agree there form one binary trie over the other bits.
Each trie is joined with itself: pairs of nodes are walked together from the root, the bits in which
they differ are added up, and a pair is dropped as soon as the sum is over the budget.

A trie with more than ``trie_rows`` fingerprints is split further: its other bits are cut into ``budget + 1``
blocks, and two linked fingerprints agree on at least one of them. What is still larger is dealt over
several tasks, as all pairs of its parts. A task returns a spanning forest of the links that it finds, not the links: a pair of nodes
whose fingerprints are all in one tree already is dropped too, so a dense group costs little.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from quillspark.llm.components import connected_components
from quillspark.llm.text import columns_of
from quillspark.scratch import materialize

SEED = 42
BLOCK_ROWS = 1 << 17
LEAF_PAIRS = 64


def fingerprint(text: bytes | None, width: int = 4) -> int:
    """The unsigned fingerprint of a text in UTF-8; zero where it has no words."""
    if not text:
        return 0
    w = text.lower().split()
    if not w:
        return 0
    flat = b" ".join(w)
    if len(w) <= width:
        hashes = np.array([xxh64_intdigest(flat, SEED)], dtype="<u8")
    else:
        ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        n = len(w) - width + 1
        hashes = np.fromiter(
            (xxh64_intdigest(flat[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)),
            dtype="<u8",
            count=n,
        )
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK_ROWS):
        part = hashes[at : at + BLOCK_ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def add_fingerprint(docs: DataFrame, text_col: str, width: int = 4, carry: list[str] | None = None) -> DataFrame:
    """rid, the columns in ``carry`` and fp (the fingerprint's bits as a signed bigint), written out once."""
    carry = carry or []
    renamed = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        *(docs[c].alias(f"c{i}") for i, c in enumerate(carry)),
        F.encode(docs[text_col], "UTF-8").alias("body"),
    )
    schema = T.StructType([*renamed.schema.fields[:-1], T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body = batch.column(batch.num_columns - 1)
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in body), dtype=np.uint64, count=len(body))
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(fps.view(np.int64))], names=[f.name for f in schema.fields])

    return materialize(renamed.mapInArrow(run, schema), "fingerprints")


def tables(budget: int, agree: int) -> list[int]:
    """The bit masks of the tries: every choice of ``agree`` of ``budget + agree`` blocks."""
    n = budget + agree
    edge = [64 * i // n for i in range(n + 1)]
    block = [(1 << edge[i + 1]) - (1 << edge[i]) for i in range(n)]
    return [sum(block[i] for i in pick) for pick in combinations(range(n), agree)]


def finer(mask: int, budget: int) -> list[int]:
    """``mask`` with each of ``budget + 1`` blocks of its other bits."""
    rest = [b for b in range(64) if not mask >> b & 1]
    edge = [len(rest) * i // (budget + 1) for i in range(budget + 2)]
    return [mask | sum(1 << b for b in rest[x:y]) for x, y in zip(edge, edge[1:])]


def agreeing_blocks(rows: int, budget: int, per_trie: int = 4096) -> int:
    """How many blocks to agree on, so that random fingerprints give about ``per_trie`` to a trie; never over 4."""
    for r in (1, 2, 3):
        if rows <= per_trie << (64 * r // (budget + r)):
            return r
    return 4


class _Forest:
    """Roots of the rows of one block of tries, in trie order."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.change = np.zeros(n, dtype=np.int64)
        self.change[1:] = np.arange(1, n)

    def link(self, x: np.ndarray, y: np.ndarray) -> None:
        root = self.root
        while len(x):
            a, b = root[x], root[y]
            apart = a != b
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            if not len(x):
                break
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while True:
                up = root[root]
                if np.array_equal(up, root):
                    break
                root = up
        self.root = root
        self.change[1:] = np.cumsum(root[1:] != root[:-1])

    def joined(self, lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> np.ndarray:
        c = self.change
        return (c[lo] == c[hi - 1]) & (c[lo2] == c[hi2 - 1]) & (self.root[lo] == self.root[lo2])


def _expand(lo: np.ndarray, hi: np.ndarray, lo2: np.ndarray, hi2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (x, y) of each pair of ranges."""
    wide = hi2 - lo2
    n = (hi - lo) * wide
    which = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return lo[which] + at // wide[which], lo2[which] + at % wide[which]


def trie_join(group: np.ndarray, side: np.ndarray, fp: np.ndarray, mask: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (fp, root's fp) of a spanning forest of the links within each group.

    ``side`` is 0 throughout a group that is joined with itself; a group with sides 0 and 1 is joined across.
    """
    rest = fp & np.uint64(~mask & 0xFFFFFFFFFFFFFFFF)
    order = np.lexsort((rest, side, group))
    group, side, fp, rest = group[order], side[order], fp[order], rest[order]
    n = len(fp)
    cuts = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (side[1:] != side[:-1]))))
    lo, hi = cuts, np.append(cuts[1:], n)
    g, s = group[lo], side[lo]
    own = np.isin(g, g[s == 1], invert=True)
    cross = np.flatnonzero(~own & (s == 0) & np.append(g[1:] == g[:-1], False))
    alo, ahi = np.append(lo[own], lo[cross]), np.append(hi[own], hi[cross])
    blo, bhi = np.append(lo[own], lo[cross + 1]), np.append(hi[own], hi[cross + 1])
    bits = [b for b in range(63, -1, -1) if not mask >> b & 1]
    sums: dict[int, np.ndarray] = {}

    def split(level: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Where the rows with a one begin."""
        if level not in sums:
            ones = np.zeros(n + 1, dtype=np.int32)
            np.cumsum((rest >> np.uint64(bits[level])) & np.uint64(1), out=ones[1:])
            sums[level] = ones
        return hi - (sums[level][hi] - sums[level][lo])

    forest = _Forest(n)
    stack = [(0, alo, ahi, blo, bhi, np.zeros(len(alo), dtype=np.int8))]
    while stack:
        level, alo, ahi, blo, bhi, d = stack.pop()
        if len(alo) > BLOCK_ROWS:
            half = len(alo) // 2
            stack.append((level, *(x[half:] for x in (alo, ahi, blo, bhi, d))))
            stack.append((level, *(x[:half] for x in (alo, ahi, blo, bhi, d))))
            continue
        live = (ahi > alo) & (bhi > blo) & (d <= budget) & ~((alo == blo) & (ahi - alo == 1))
        alo, ahi, blo, bhi, d = alo[live], ahi[live], blo[live], bhi[live], d[live]
        live = ~forest.joined(alo, ahi, blo, bhi)
        alo, ahi, blo, bhi, d = alo[live], ahi[live], blo[live], bhi[live], d[live]
        leaf = ((ahi - alo) * (bhi - blo) <= LEAF_PAIRS) | (level == len(bits))
        if leaf.any():
            x, y = _expand(alo[leaf], ahi[leaf], blo[leaf], bhi[leaf])
            near = (x != y) & (np.bitwise_count(rest[x] ^ rest[y]) <= budget)
            forest.link(x[near], y[near])
        alo, ahi, blo, bhi, d = alo[~leaf], ahi[~leaf], blo[~leaf], bhi[~leaf], d[~leaf]
        if not len(alo):
            continue
        am, bm = split(level, alo, ahi), split(level, blo, bhi)
        same = alo == blo  # a node with itself: its two halves meet once
        stack.append((
            level + 1,
            np.concatenate((alo, am, alo, am[~same])),
            np.concatenate((am, ahi, am, ahi[~same])),
            np.concatenate((blo, bm, bm, blo[~same])),
            np.concatenate((bm, bhi, bhi, bm[~same])),
            np.concatenate((d, d, d + 1, d[~same] + 1)),
        ))
    linked = np.flatnonzero(forest.root != np.arange(n))
    return fp[linked], fp[forest.root[linked]]


def links(fps: DataFrame, *, budget: int = 4, agree: int | None = None, trie_rows: int = 16384) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column ``fp``) that connect whatever is linked."""
    if agree is None:
        agree = agreeing_blocks(fps.count(), budget)
    coarse = tables(budget, agree)
    assert len(coarse) == comb(budget + agree, agree)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    each = budget + 2  # a trie and its finer ones
    masks = [m for mask in coarse for m in (mask, *finer(mask, budget))]
    key = lambda t, m: F.struct(t.cast("int").alias("t"), F.col("fp").bitwiseAND(m).alias("k"))
    rows = fps.select("fp", F.explode(F.array(*(key(F.lit(each * t), F.lit(signed(m))) for t, m in enumerate(coarse)))).alias("x")).select("fp", "x.t", "x.k")
    count = lambda df: materialize(df.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > trie_rows), "large-tries")
    large = count(rows)
    parts = F.lit(1)
    if large.limit(1).count():
        known = F.array(*(F.lit(signed(m)).cast("bigint") for m in masks))
        split = F.array(*(key(F.col("t") + i, F.element_at(known, F.col("t") + i + 1)) for i in range(1, each)))
        marked = rows.join(large, ["t", "k"], "left").select("fp", "t", "k", F.when(F.col("n").isNull(), F.array(F.struct("t", "k"))).otherwise(split).alias("xs"))
        rows = marked.select("fp", F.explode("xs").alias("x")).select("fp", "x.t", "x.k")
        rows = rows.join(count(rows), ["t", "k"], "left")
        parts = F.coalesce(F.ceil(F.col("n") / trie_rows), F.lit(1))
    dealt = rows.select("fp", "t", "k", parts.cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    dealt = dealt.select("fp", "t", "k", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    dealt = dealt.select(
        "t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        (F.col("own") > F.col("other")).cast("int").alias("side"), "fp",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(table: pa.Table) -> Iterator[pa.RecordBatch]:
            t, k, i, j, side, fp = (table.column(c).to_numpy() for c in ("t", "k", "i", "j", "side", "fp"))
            new = (t[1:] != t[:-1]) | (k[1:] != k[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            group = np.concatenate(([0], np.cumsum(new)))
            for one in np.unique(t):
                at = t == one
                u, v = trie_join(group[at], side[at], fp[at].view(np.uint64), masks[one], budget)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 4 * BLOCK_ROWS:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            key = [table.column(c).to_numpy() for c in ("t", "k", "i", "j")]
            rest = np.logical_and.reduce([c == c[-1] for c in key])
            cut = int(np.flatnonzero(~rest)[-1]) + 1 if not rest.all() else 0
            if cut:
                yield from edges(table.slice(0, cut))
            held = table.slice(cut).to_batches()
            rows = len(table) - cut
        if rows:
            yield from edges(pa.Table.from_batches(held).combine_chunks())

    return dealt.repartition("t", "k", "i", "j").sortWithinPartitions("t", "k", "i", "j").mapInArrow(run, "u bigint, v bigint")


def assign_components(marked: DataFrame, *, budget: int = 4, trie_rows: int = 16384, agree: int | None = None) -> DataFrame:
    """fp, root for every distinct fingerprint of ``marked``."""
    fps = materialize(marked.select("fp").distinct(), "distinct-fingerprints")
    stars = connected_components(links(fps, budget=budget, trie_rows=trie_rows, agree=agree))
    out = fps.join(stars, fps["fp"] == stars["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"))
    return out


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, budget: int = 4, trie_rows: int = 16384, agree: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id, and n_docs of the component, a row per row of ``docs``.

    Texts are lower-cased (A-Z), cut into words and shingles of ``width`` words, repeats included; fewer
    words make one shingle, none make fingerprint zero, as does a null text. component_id is the
    smallest id that links reach; null ids don't count there and stay null (a component without ids
    has a null component_id). Repeated rows each get a row. An empty table gives an empty table.
    Extra columns are ignored.
    """
    columns_of(docs, [id_col, text_col])
    marked = add_fingerprint(docs, text_col, width, [id_col])
    roots = assign_components(marked, budget=budget, trie_rows=trie_rows, agree=agree)
    firsts = marked.groupBy("fp").agg(F.min("c0").alias("least"), F.count("*").alias("n"))
    tree = materialize(roots.join(firsts, "fp"), "roots")
    groups = materialize(tree.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("n_docs")), "components")
    of = tree.select("fp", "root").join(groups, "root").select("fp", "component_id", "n_docs")
    return marked.join(of, "fp").select(
        F.col("c0").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_docs"
    )


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, budget: int = 4) -> DataFrame:
    """The rows of ``docs`` with one of each component left: the smallest id (nulls last), the first row on ties.

    Shingles have ``width`` words. Null texts, empty ones and those without words are one component; repeated rows are, too. All columns are
    kept, whatever they are called; an empty table gives an empty table.
    """
    columns_of(docs, [id_col, text_col])
    names = list(docs.columns)
    marked = add_fingerprint(docs, text_col, width, names)
    at = f"c{names.index(id_col)}"
    narrow = marked.select("rid", "fp", F.struct(F.col(at).isNull().alias("none"), F.col(at).alias("id"), F.col("rid").alias("row")).alias("o"))
    firsts = narrow.groupBy("fp").agg(F.min("o").alias("o"))
    keep = assign_components(marked, budget=budget).join(firsts, "fp").groupBy("root").agg(F.min("o").alias("o")).select(F.col("o.row").alias("rid"))
    return marked.join(keep, "rid", "left_semi").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
