"""Sharding by balanced label propagation.

Documents that share a text are linked. Links are kept as cells (text, shard) with a count, so a group
of any size costs a row per shard. In each round every cell asks to move to the shard that holds
most of its text. Moves are let in, small cells first, as far as a shard's rows that leave and its room
under its quota allow, so full shards exchange cells. Rounds go on until nothing moves. Texts that are
still cut are put whole where there is room. Then documents
without links fill the shards to their exact row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspark.llm.ranks import spread_rank
from quillspark.llm.text import columns_of
from quillspark.scratch import discard, materialize

def _pick(values: list[int], shard: Column) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), shard + 1)


def _loads(cells: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["n"] for r in cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [got.get(s, 0) for s in range(shards)]


def _admit(asked: dict[tuple[int, int, int], int], room: list[int]) -> dict[tuple[int, int, int], int]:
    """How many cells (from, to, n) move: as asked, less what would fill a shard beyond its room, with what leaves it counted as room."""
    moves = dict(asked)
    into: dict[int, list[tuple[int, int, int]]] = {}
    net = [0] * len(room)
    for (source, best, n), count in moves.items():
        into.setdefault(best, []).append((source, best, n))
        net[best] += n * count
        net[source] -= n * count
    again = True
    while again:
        again = False
        for best, found in into.items():
            if net[best] <= room[best]:
                continue
            for key in sorted(found, key=lambda k: (-k[2], net[k[0]] - room[k[0]])):
                source, _, n = key
                cut = min(moves[key], max(0, -(-(net[best] - room[best]) // n)))
                if cut:
                    moves[key] -= cut
                    net[best] -= n * cut
                    net[source] += n * cut
                    again = True
    return moves


def propagate(cells: DataFrame, targets: list[int], rounds: int | None = None) -> DataFrame:
    """g, origin, shard, n after label propagation over ``cells`` (same columns), materialised.

    It ends when two rounds in turn move nothing, or after ``rounds``. Each move gathers a group further (the
    sum of squares of its counts grows), so it ends.
    """
    spark, shards = cells.sparkSession, len(targets)
    now = materialize(cells, "cells")
    cells_in_all = now.count()
    idle = turn = 0
    while idle < 2 and (rounds is None or turn < rounds):
        room = [t - n for t, n in zip(targets, _loads(now, shards), strict=True)]
        held = now.groupBy("g", "shard").agg(F.sum("n").alias("n"))
        smallest = held.groupBy("g").agg(F.min("n").alias("least"))
        # Rounds that look for room take turns with rounds that only exchange; ties fall anew in each.
        fits = (_pick([max(0, r) for r in room], F.col("shard")) >= F.col("least")) if turn % 2 == 0 else F.lit(True)
        rank = F.struct(fits.alias("fits"), F.col("n"), F.xxhash64("g", "shard", F.lit(turn)).alias("tie"), "shard")
        wanted = held.join(smallest, "g").groupBy("g").agg(F.max(rank).alias("top")).select("g", F.col("top.shard").alias("best"), F.col("top.n").alias("there"))
        asked = now.join(wanted, "g").join(held.withColumnRenamed("n", "here"), ["g", "shard"]).where("shard <> best AND here <= there")
        asked = materialize(asked.select("g", "origin", "shard", "best", "n"), "asked")
        sums = {(r["shard"], r["best"], r["n"]): r["c"] for r in asked.groupBy("shard", "best", "n").agg(F.count("*").alias("c")).collect()}
        let_in = [(*k, c) for k, c in _admit(sums, room).items() if c]
        turn, idle = turn + 1, 0 if let_in else idle + 1
        if let_in:
            most = F.broadcast(spark.createDataFrame(let_in, "shard int, best int, n bigint, most bigint"))
            ranked = spread_rank(asked, ["shard", "best", "n"], F.xxhash64("g", "origin"), ["g", "origin"], "at", cells_in_all)
            moves = ranked.join(most, ["shard", "best", "n"]).where("at < most").select("g", "origin", "best")
            then, now = now, materialize(now.join(moves, ["g", "origin"], "left").select("g", "origin", F.coalesce("best", "shard").alias("shard"), "n"), "cells")
            discard(then)
        discard(asked)
    return now


def gather(cells: DataFrame, targets: list[int]) -> DataFrame:
    """``cells`` with each text that is still cut, and no longer than a shard, put whole into a shard with room for it.

    Longest first. Texts that then fit nowhere get no shard here: their documents are dealt like those without links.
    """
    sizes = cells.groupBy("g").agg(F.sum("n").alias("all"), F.count_distinct("shard").alias("parts"))
    cut = materialize(sizes.where((F.col("parts") > 1) & (F.col("all") <= min(targets))).select("g", "all"), "cut")
    counts = {r["all"]: r["c"] for r in cut.groupBy("all").agg(F.count("*").alias("c")).collect()}
    if not counts:
        return cells
    rest = cells.join(cut.select("g"), "g", "left_anti")
    room = [max(0, t - n) for t, n in zip(targets, _loads(rest, len(targets)), strict=True)]
    quotas = []
    for size in sorted(counts, reverse=True):
        low = 0
        for s in sorted(range(len(room)), key=lambda s: -room[s]):
            k = min(counts[size] - low, room[s] // size)
            if k > 0:
                quotas.append((size, s, low, low + k))
                low, room[s] = low + k, room[s] - k * size
    quota = F.broadcast(cells.sparkSession.createDataFrame(quotas, "all bigint, whole int, low bigint, high bigint"))
    ranked = spread_rank(cut, ["all"], F.xxhash64("g"), ["g"], "at", sum(counts.values()))
    placed = ranked.join(quota, "all").where("at >= low AND at < high").select("g", "whole")
    put = cells.join(placed, "g").select("g", "origin", F.col("whole").alias("shard"), "n")
    return materialize(rest.select("g", "origin", "shard", "n").unionByName(put), "cells")


def shard_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 16, rounds: int | None = None, carry: bool = False,
) -> DataFrame:
    """doc_id, size, text_crc32, law (``rows``), shard, slot for every row; with ``carry``, its columns, shard and slot.

    Shards differ by one row at most. Slots run from 0 without gaps. Size is the text's bytes in UTF-8
    plus 1; a null text has none and is linked to empty texts. Null ids and repeated rows get places like
    any row; rows that agree in all columns are interchangeable. An empty table gives an empty table. Columns
    of ``docs`` called shard or slot are replaced.
    """
    columns_of(docs, [id_col, text_col])
    names = [c for c in docs.columns if c not in ("shard", "slot")]
    text = F.encode(F.coalesce(docs[text_col], F.lit("")), "UTF-8")
    nodes = docs.select(
        F.monotonically_increasing_id().alias("rid"),
        docs[id_col].alias("doc_id"),
        text.alias("body"),
        *((docs[c].alias(f"c{i}") for i, c in enumerate(names)) if carry else ()),
    )
    nodes = materialize(
        nodes.select(
            "*", (F.length("body") + 1).cast("long").alias("size"), F.crc32("body").alias("crc"), F.xxhash64("body").alias("g"),
            F.xxhash64("doc_id", "body").alias("h"),
        ).drop("body").withColumn("start", F.pmod("h", F.lit(shards)).cast("int")),
        "nodes",
    )
    narrow = nodes.select("rid", "doc_id", "size", "crc", "g", "h", "start")
    total = narrow.count()
    targets = [total // shards + (s < total % shards) for s in range(shards)]
    cells = narrow.groupBy("g", "start").agg(F.count("*").alias("n"))
    linked = cells.groupBy("g").agg(F.sum("n").alias("all")).where("all > 1").select("g")
    settled = propagate(
        cells.join(linked, "g").select("g", F.col("start").alias("origin"), F.col("start").alias("shard"), "n"), targets, rounds
    )
    settled = gather(settled, targets)
    loads = _loads(settled, shards)
    placed = narrow.join(settled.select("g", F.col("origin").alias("start"), "shard"), ["g", "start"], "left")
    if any(n > t for n, t in zip(loads, targets, strict=True)):
        kept = spread_rank(placed.where("shard IS NOT NULL"), ["shard"], F.xxhash64("g"), ["g", "h", "doc_id"], "at", total)
        kept = kept.withColumn("shard", F.when(F.col("at") < _pick(targets, F.col("shard")), F.col("shard"))).drop("at")
        placed = materialize(placed.where("shard IS NULL").unionByName(kept), "placed")
        loads = [min(n, t) for n, t in zip(loads, targets, strict=True)]
    free = spread_rank(placed.where("shard IS NULL").drop("shard").withColumn("all", F.lit(0)), ["all"], F.xxhash64("h"), ["h", "doc_id"], "at", total)
    edge, where = 0, F.lit(shards - 1)
    edges = []
    for n, t in zip(loads, targets, strict=True):
        edge += t - n
        edges.append(edge)
    for s in range(shards - 2, -1, -1):
        where = F.when(F.col("at") < edges[s], F.lit(s)).otherwise(where)
    filled = free.withColumn("shard", where.cast("int")).drop("at", "all").unionByName(placed.where("shard IS NOT NULL"))
    out = spread_rank(filled, ["shard"], F.xxhash64("h", F.lit(1)), ["h", "doc_id"], "slot", total)
    if carry:
        return nodes.drop("doc_id", "size", "crc", "g", "h", "start").join(out.select("rid", "shard", "slot"), "rid").select(
            *(F.col(f"c{i}").alias(c) for i, c in enumerate(names)), "shard", "slot"
        )
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
