import random
from collections import Counter

from quillspark.llm.decontaminate import contaminated, drop_contaminated


def shingles(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items, radius_free=0.8):
    out = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i, s in items:
            v = (s or "").lower().split()
            if not v or i is None:
                continue
            k = min(5, len(v))
            a = shingles(v, k)
            for at in range(1 - len(v), len(w)):
                b = shingles(w[max(at, 0) : at + len(v)], k)
                m = sum((a & b).values())
                n = sum(a.values()) + sum(b.values()) - m
                if n and m / n >= radius_free:
                    out[d, i] = max(out.get((d, i), 0), m / n)
    return out


def make(seed):
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(3000)
    items = [(i, " ".join(word() for _ in range(rng.randint(15, 60)))) for i in range(12)]
    items += [(20, "Tiny item"), (21, "one"), (22, None), (23, ""), (None, "no id at all here friend"), (24, "again and " * 12), (25, items[0][1])]
    docs = []
    for d in range(60):
        w = [word() for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.7:
            p = rng.choice(items[:12])[1].split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(p))
                p[at : at + 1] = rng.choice(([], ["new"], [p[at], "more"]))
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() for x in p[rng.randint(0, 3) :]]
        docs.append((d, " \n".join(w)))
    docs += [(100, None), (101, ""), (102, "xx Tiny  item yy"), (103, "ONE"), (None, items[2][1]), (104, "again and " * 40), (3, docs[3][1])]
    return docs, items


def test_brute_force(spark):
    docs, items = make(4)
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "'q' AS row_key", "1 AS len")
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS fp")
    want = brute(docs, items)
    for rows in (500_000, 0):
        got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(d, b, broadcast_rows=rows).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    kept = drop_contaminated(d, b)
    bad = {k for k, _ in want}
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted((k for k, _ in docs if k not in bad), key=str)


def test_reordered_items(spark):
    rng = random.Random(6)
    items, docs = [], []
    for i in range(12):
        v = ["i%d_%d" % (i, j) for j in range(rng.randint(45, 60))]
        cut = rng.randint(12, len(v) - 12)
        items.append((i, " ".join(v)))
        around = [["x%d_%d_%d" % (i, side, j) for j in range(rng.choice((0, 3, 70)))] for side in (0, 1)]
        docs.append((i, " ".join(around[0] + v[cut:] + v[:cut] + around[1])))
    v = items[0][1].split()
    docs.append((90, " ".join(["y"] * 80 + v[30:] + v[15:30] + v[:15])))
    want = brute(docs, items)
    assert len(want) >= 10
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for rows in (500_000, 0):
        got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(d, b, broadcast_rows=rows).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_repeated_items_and_exact_threshold(spark):
    v = ["r%d" % j for j in range(20)]
    ten = ["e%d" % j for j in range(14)]
    items = [(1, " ".join(v))] * 10 + [(2, "p q r s t u v"), (2, "a b c d e f g"), (3, " ".join(ten))]
    docs = [(100 + j, " ".join(v[:j] + ["new"] + v[j + 1 :])) for j in (0, 19)]
    docs += [(200, "p q r s t u v"), (201, "a b c d e f g"), (202, " ".join(ten[:12])), (203, " ".join(ten[2:])), (204, " ".join(ten[1:13]))]
    want = brute(docs, items)
    assert {d for d, _ in want} == {d for d, _ in docs}
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(d, b).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_no_python_in_the_plan(spark):
    docs, items = make(5)
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    plan = contaminated(d, b)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_empty(spark):
    d, b = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    full_b = spark.createDataFrame([(1, "some item words here now")], "item_id bigint, text string")
    full_d = spark.createDataFrame([(1, "some item words here now")], "doc_id bigint, text string")
    assert contaminated(d, full_b).count() == 0 and contaminated(full_d, b).count() == 0
    assert drop_contaminated(full_d, b).count() == 1 and contaminated(full_d, full_b).count() == 1


def test_short_items_against_brute_force(spark):
    """Items of 5 to 13 words, where few shingles vote for a bit."""
    rng = random.Random(8)
    items = [(i, " ".join("s%d_%d" % (i, rng.randrange(40)) for _ in range(5 + i % 9))) for i in range(270)]
    docs = []
    for i, t in items:
        v = t.split()
        for copy in range(3):
            around = [["z%d" % rng.randrange(10**6) for _ in range(rng.choice((0, 4)))] for _ in (0, 1)]
            cut = rng.choice([v, v[1:], v[:-1], v[2:], v[:-2], v[:-1] + ["new"], ["new"] + v[1:]])
            docs.append((3 * i + copy, " ".join(around[0] + cut + around[1])))
    want = brute_by_item(docs, items)
    assert 200 < len(want) < 800
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contaminated(d, b).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)


def brute_by_item(docs, items):
    """Items of different numbers share no word here."""
    out = {}
    for i, t in items:
        out |= brute([x for x in docs if x[0] // 3 == i], [(i, t)])
    return out


def test_long_document_and_text_ids(spark):
    rng = random.Random(9)
    v = ["p%d" % j for j in range(40)]
    w = ["l%d" % rng.randrange(5000) for _ in range(30_000)]
    for at in (0, 4080, 8192, 29_960):
        w[at : at + 40] = v[:20] + ["x"] + v[21:]
    d = spark.createDataFrame([("long", " ".join(w)), ("clean", " ".join(w[100:4000])), (None, None)], "doc_id string, text string")
    b = spark.createDataFrame([("i", " ".join(v)), ("twin", " ".join(v))], "item_id string, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, round(r.similarity, 6)) for r in contaminated(d, b).collect()}
    assert not got  # five of 36 shingles differ on either side: 31 of 41
    d2 = d.selectExpr("doc_id", "replace(text, 'x', 'p20') AS text")
    got = {(r.doc_id, r.item_id): r.first_word for r in contaminated(d2, b).collect()}
    assert got == {("long", "i"): 0, ("long", "twin"): 0}
    assert {r.doc_id for r in drop_contaminated(d2, b).collect()} == {"clean", None}
