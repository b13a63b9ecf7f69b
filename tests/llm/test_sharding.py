import random
import zlib

import pytest

from quillspark.llm.sharding import shard_documents


@pytest.mark.parametrize("kind", ["mixed", "hot", "all linked"])
def test_law_and_slots(spark, kind):
    rng = random.Random(3)
    texts = ["t%d é" % i for i in range(300)]
    copies = {"mixed": 2, "hot": 120, "all linked": 5}[kind]
    if kind == "all linked":
        texts = [t for t in texts[:60] for _ in range(copies)]
    else:
        texts += [texts[0]] * copies + [texts[1]] * 4 + [None, "", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5]), (None, "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'q' AS shard", "1 AS g")
    got = shard_documents(df).toPandas()
    assert len(got) == len(rows)
    counts = got.groupby("shard").size().reindex(range(16), fill_value=0)
    assert counts.max() - counts.min() <= 1 and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    for s, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    want = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    assert sorted(zip(got["size"], got.text_crc32)) == want
    spread = got.groupby("text_crc32").shard.nunique()
    sizes = got.groupby("text_crc32").size()
    small = (sizes > 1) & (sizes <= 6)
    assert (spread[small] == 1).mean() > (0.5 if kind == "all linked" else 0.99)
    if kind == "hot":
        assert spread[sizes.idxmax()] <= 10


def test_carry_and_empty(spark):
    df = spark.createDataFrame([(1, "a", 7), (2, "a", 8)], "doc_id bigint, text string, c0 int")
    got = shard_documents(df, carry=True)
    assert got.columns == ["doc_id", "text", "c0", "shard", "slot"] and got.count() == 2
    assert shard_documents(df.where("doc_id > 5")).count() == 0


@pytest.mark.parametrize("copies", [2, 8])
def test_full_shards_exchange_cells(spark, copies):
    df = spark.range(3200).selectExpr("id AS doc_id", f"concat('text ', id div {copies}) AS text")
    got = shard_documents(df).toPandas()
    assert set(got.groupby("shard").size()) == {200}
    spread = got.groupby("text_crc32").shard.nunique()
    assert (spread > 1).sum() < 16


def slow_propagation(groups, start, targets):
    """Cells (group, shard) move one by one to where most of their group is, while there is room, or change places with a cell of their size."""
    cells = {}
    for g, s in zip(groups, start):
        cells[g, s] = cells.get((g, s), 0) + 1
    load = [sum(n for (_, s), n in cells.items() if s == t) for t in range(len(targets))]
    while True:
        wish = {}
        for (g, s), n in cells.items():
            best = max((m, -t) for (h, t), m in cells.items() if h == g)
            if -best[1] != s and n <= best[0]:
                wish[g, s] = (-best[1], n)
        moved = False
        for (g, s), (t, n) in sorted(wish.items(), key=lambda x: (x[1][1], str(x[0]))):
            if (g, s) not in cells:
                continue
            partner = next((k for k, (u, m) in wish.items() if k in cells and k[1] == t and u == s and m == n and k[0] != g), None)
            if load[t] + n <= targets[t]:
                load[s], load[t], moves = load[s] - n, load[t] + n, [((g, s), t)]
            elif partner is not None:
                moves = [((g, s), t), (partner, s)]
            else:
                continue
            for k, to in moves:
                cells[k[0], to] = cells.get((k[0], to), 0) + cells.pop(k)
            moved = True
        if not moved:
            return cells


def cut_pairs(cells):
    """Linked pairs of documents in different shards."""
    sizes = {}
    for (g, _), n in cells.items():
        sizes.setdefault(g, []).append(n)
    return sum((sum(ns) ** 2 - sum(n * n for n in ns)) // 2 for ns in sizes.values())


@pytest.mark.parametrize("linked", [0.6, 1.0])
def test_cut_edges_against_a_slow_propagation(spark, linked):
    rng = random.Random(8)
    groups = [g for g in range(90) for _ in range(rng.choice([2, 2, 3, 5, 9]))]
    total = int(len(groups) / linked)
    rows = [(i, f"text {g}") for i, g in enumerate(groups)] + [(10_000 + i, f"own {i}") for i in range(total - len(groups))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = shard_documents(df).toPandas()
    counts = got.groupby("text_crc32").size()
    ours = {(c, s): n for (c, s), n in got.groupby(["text_crc32", "shard"]).size().items() if counts[c] > 1}
    targets = [total // 16 + (s < total % 16) for s in range(16)]
    slow = slow_propagation(groups, [rng.randrange(16) for _ in groups], targets)
    apart = {(g, i): 1 for i, g in enumerate(groups)}
    assert cut_pairs(ours) <= cut_pairs(slow) + 0.01 * cut_pairs(apart)
    spread = got.groupby("text_crc32").shard.nunique()[counts > 1]
    assert (spread == 1).mean() > (0.99 if linked < 1 else 0.9)
