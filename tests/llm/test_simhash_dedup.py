import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from quillspark.llm.simhash_dedup import drop_near_copies, fingerprint, links, simhash_groups


def slow_fingerprint(text):
    w = "".join(c.lower() if c < "\x80" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    parts = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    hs = [xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and near(a, b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", None, " \n", "One", "a b c", "a B c d", "É È é a b\x0bc d e f " * 30, "x y z w v"])
def test_fingerprint(text):
    assert fingerprint(text.encode() if text else None) == slow_fingerprint(text)


@pytest.mark.parametrize("agree,trie_rows", [(1, 10_000), (1, 40), (2, 10_000), (3, 50)])
def test_links_connect_what_is_near(spark, agree, trie_rows):
    rng = random.Random(agree + trie_rows)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:30]:
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 6)):
                g ^= 1 << b
            fps.append(g)
    base = rng.getrandbits(64)
    fps += [base ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]
    fps = sorted({int(np.uint64(f).view(np.int64)) for f in fps})
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint").repartition(3)
    edges = [(r.u, r.v) for r in links(df, agree=agree, trie_rows=trie_rows).collect()]
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    assert all(bits(a, b) <= 64 for a, b in edges)
    linked = {frozenset(e) for e in edges}
    got = slow_components(fps, lambda a, b: frozenset((a, b)) in linked)
    assert got == slow_components(fps, lambda a, b: bits(a, b) <= 4)


def test_groups(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    long = [word() for _ in range(400)]
    near = list(long)
    near[200] = "changed"
    rows = [(3, " ".join(long)), (1, " ".join(near)), (2, " ".join(long).upper()), (7, None), (8, ""), (9, "  "), (4, "other words here"), (4, "other words here"), (None, "alone but real"), (5, " ".join(word() for _ in range(9000)))]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS fp", "1 AS rid", "doc_id AS component_id")
    got = simhash_groups(df).toPandas()
    fps = [slow_fingerprint(t) for _, t in rows]
    groups = slow_components(range(len(rows)), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 4)
    want = []
    for i, (k, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if groups[j] == groups[i] and rows[j][0] is not None]
        want.append((k, f"{fps[i]:016x}", min(ids, default=None)))
    clean = lambda x: None if x is None or x != x else int(x)
    have = [(clean(r.doc_id), r.fingerprint, clean(r.component_id)) for r in got.itertuples()]
    assert sorted(have, key=str) == sorted(want, key=str)
    kept = drop_near_copies(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(ids, key=str) == sorted([1, 7, 4, None, 5], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash_groups(df).count() == 0
    assert drop_near_copies(df).count() == 0
