import random

import numpy as np
import pytest

from quillspark.llm import mixing
from quillspark.llm.mixing import mix_sources, newton_tilts, take_mix


def rows(seed=1, n=400):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 30, 200, 900]) if i % 3 else rng.randint(1, 3000)
        out.append((i, " ".join(["w"] * size), rng.choice(["big"] * 8 + ["ä", "b", "Z", None, ""])))
    return out + [(1, "x y", "b"), (1, "x y", "b"), (None, "x y z", "b"), (7, None, "only null"), (8, "q " * 40, "tiny")]


def slow_targets(sizes, cap=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        left = total - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= cap * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: cap * sizes[s] for s in over}
        if len(fixed) == len(names):
            return fixed


def test_mix(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string").selectExpr("*", "1 AS key", "2 AS size", "3 AS rid")
    got = mix_sources(df).collect()
    again = mix_sources(df.repartition(7)).collect()
    as_rows = lambda x: sorted(map(tuple, x), key=str)
    assert as_rows(got) == as_rows(again) and len(got) == len(data)
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = slow_targets(sizes)
    by_target = {}
    for r in got:
        assert r.taken == r.size * r.copies and 0 <= r.copies <= 3
        by_target.setdefault((r.source_size, round(r.target, 6)), 0)
        by_target[r.source_size, round(r.target, 6)] += r.taken
    for s, t in want.items():
        assert abs(by_target[sizes[s], round(t, 6)] - t) <= max(0.03 * t, 60)
    assert sum(sizes.values()) == pytest.approx(sum(want.values()))


def test_prior_tilts_and_caps(spark):
    data = [(i, "w " * 100, "a" if i % 4 else "b", 5.0 if i % 2 else 0.5) for i in range(400)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string, prior double")
    got = mix_sources(df, prior_col="prior").join(df, "doc_id").groupBy("source", "prior").agg({"copies": "avg", "taken": "sum"}).toPandas()
    assert abs(got["sum(taken)"].sum() - 40_000) < 1500
    a = got[got.source == "a"].set_index("prior")["avg(copies)"]
    assert a[5.0] > a[0.5]


def test_take(spark):
    data = rows(2, 60)
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string").selectExpr("*", "source AS copies")
    taken = take_mix(df)
    assert taken.columns == df.columns
    assert taken.count() == mix_sources(df).agg({"copies": "sum"}).first()[0]
    assert take_mix(df.where("doc_id < -5")).count() == 0
    assert mix_sources(df.where("text IS NULL")).first().taken == 0


def slow_tilt(size, prior, target, cap=3.0):
    """Newton on the dual with numpy, from a bracket."""
    scale = (size**2).sum() / size.sum()
    rate = lambda lam: np.minimum(cap, np.exp(np.minimum(np.log(prior) + lam * size / scale, np.log(cap))))
    lo, hi = -1e4, (np.log(cap / prior) / size).max() * scale
    if target >= cap * size.sum():
        return scale, hi
    lam = min(0.0, hi)
    for _ in range(300):
        r = rate(lam)
        f, h = (size * r).sum(), (size * size / scale * r)[r < cap].sum()
        lo, hi = (lo, lam) if f > target else (lam, hi)
        if abs(f - target) <= 1e-12 * target:
            break
        new = lam + (target - f) / h if h else lo - 1
        lam = new if lo < new < hi else (lo + hi) / 2
    return scale, lam


def test_newton_solves_the_dual(spark, monkeypatch):
    rng = np.random.default_rng(5)
    parts, targets, want = [], [], {}
    for key, share, priors in [("less", 0.07, [1.0]), ("tiny", 1e-4, [1.0]), ("same", 1.0, [1.0]), ("more", 1.7, [1.0]), ("much", 2.95, [1.0]), ("all", 3.0, [1.0]), ("prior", 0.8, [0.2, 1.0, 5.0]), ("over", 0.5, [6.0])]:
        size = np.ceil(rng.lognormal(5, 1.4, 600))
        prior = rng.choice(priors, 600)
        parts += [(key, float(p), int(z), 1) for p, z in zip(prior, size)]
        targets.append((key, float(share * size.sum())))
        want[key] = slow_tilt(size, prior, targets[-1][1])
    groups = spark.createDataFrame(parts, "key string, prior double, size long, n long").groupBy("key", "prior", "size").agg({"n": "count"}).withColumnRenamed("count(n)", "n")
    written = []
    real = mixing.materialize
    monkeypatch.setattr(mixing, "materialize", lambda df, name: written.append(name) or real(df, name))
    got = {r.key: r for r in newton_tilts(groups, spark.createDataFrame([*targets, ("none", 0.0), ("wordless", 5.0)], "key string, target double"), 3).collect()}
    assert got.keys() == want.keys() and 4 <= len(written) <= 60
    for key, (scale, lam) in want.items():
        assert got[key].scale == pytest.approx(scale, rel=1e-9)
        assert got[key].lam == pytest.approx(lam, rel=1e-6, abs=1e-6)


def test_tilts_lean_by_size(spark):
    rng = random.Random(4)
    data = [(i, "w " * rng.choice([50, 400]), "a" if i < 300 else "b") for i in range(1200)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    got = mix_sources(df, weights=[2.0, 1.0]).toPandas().groupby(["source_size", "size"]).copies.mean()
    less, more = (got[s] for s in sorted(got.index.levels[0], reverse=True))
    assert more[400] > more[50] and less[400] < less[50]


def test_empty_and_text_ids(spark):
    df = spark.createDataFrame([("x", "a b", "s"), ("y", None, None), ("x", "a b", "s")], "doc_id string, text string, source string")
    got = mix_sources(df).collect()
    assert sorted(r.doc_id for r in got) == ["x", "x", "y"] and sum(r.taken for r in got) == 4
    assert mix_sources(df.where("doc_id = 'z'")).count() == 0


def test_copies_round_the_brute_force_rates(spark):
    """Every document gets the whole number below or above its rate, and the sums follow the targets."""
    rng = random.Random(11)
    data = [(i, "w " * max(1, int(rng.lognormvariate(4, 1.2))), rng.choice("aaab") if i % 50 else "c") for i in range(1500)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, source string")
    got = {r.doc_id: r for r in mix_sources(df).collect()}
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    targets = slow_targets(sizes)
    for s, target in targets.items():
        mine = [(i, len(t.split())) for i, t, x in data if x == s]
        size = np.array([n for _, n in mine], dtype=float)
        scale, lam = slow_tilt(size, np.ones(len(size)), target)
        rate = np.minimum(3.0, np.exp(lam * size / scale))
        copies = np.array([got[i].copies for i, _ in mine])
        assert (copies >= np.floor(rate - 1e-6)).all() and (copies <= np.ceil(rate + 1e-6)).all()
        assert abs((copies * size).sum() - target) <= max(0.02 * target, size.max())
        # Documents of like size share a rate: their mean number of copies follows it.
        order = np.argsort(size)
        for part in np.array_split(order, 5):
            if len(part) >= 100:
                assert abs(copies[part].mean() - rate[part].mean()) < 0.15
