import random
from collections import Counter

from quillspark.llm.quality_rules import SYMBOLS, quality_rules


def slow(rows, least, share, left):
    norm = lambda line: " ".join(line.lower().split())
    unique = {(h, t or "") for _, t, h in rows}
    docs, seen = Counter(h for h, _ in unique), Counter()
    for h, t in unique:
        seen.update({(h, norm(x)) for x in t.split("\n") if x.strip()})
    out = []
    for k, t, h in rows:
        t = t or ""
        w = t.split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        twice = {g for g, c in Counter(grams).items() if c > 1}
        covered = {i + d for i, g in enumerate(grams) if g in twice for d in range(3)}
        lines = [x for x in t.split("\n") if x.strip()]
        failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
        cut = sum(len(x.split()) for x in lines if seen[h, norm(x)] > max(least, share * docs[h]))
        out.append((k, len(w), sum(map(len, w)), sum(t.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), len(covered), failed, not failed and len(w) - cut >= left * len(w), cut))
    return sorted(out, key=str)


def test_brute_force(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["é", "b#", "C", "d|", "*"]) if rng.random() < 0.2 else "w%d" % rng.randrange(500)
    common = "Read  our COOKIE policy | now"
    rows = []
    for k in range(90):
        lines = [" ".join(word() for _ in range(rng.randint(0, 14))) for _ in range(rng.randint(0, 12))]
        if k % 3:
            lines.insert(rng.randint(0, len(lines)), rng.choice([common, common.lower(), common + " "]))
        if k % 7 == 0:
            lines += lines[:2] + ["x y z " * 30]
        if k % 11 == 0:
            lines = [common] * 20
        rows.append((k, "\n".join(lines), rng.choice(["big", "big", "small", None])))
    rows += [(5, rows[5][1], "big")] * 3 + [(100, None, "big"), (101, "", None), (None, "a b c " * 20, "x"), (102, "only one line " * 9000, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS rid", "'h' AS host", "2 AS n_words")
    for least, share in ((5, 0.0), (2, 0.5)):
        got = sorted(map(tuple, quality_rules(df, line_min_docs=least, line_max_share=share).collect()), key=str)
        assert got == slow(rows, least, share, 0.3)


def test_kept_texts(spark):
    common = "Read our cookie  policy"
    rows = [(i, f"own line {i}\n{common}\n\n  {common.upper()} \nlast {i}", "h") for i in range(8)]
    rows += [(20, f"{common}\nonly here", "other"), (21, None, "h"), (22, common, "h"), (23, " \n \nx", "h")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").selectExpr("*", "1 AS gone", "'q' AS kept_text")
    got = {r.doc_id: (r.kept_text, r.n_line_words_removed) for r in quality_rules(df, texts=True).collect()}
    for i in range(8):
        assert got[i] == (f"own line {i}\n\nlast {i}", 8)
    assert got[20] == (rows[8][1], 0) and got[21] == ("", 0) and got[22] == ("", 4) and got[23] == (" \n \nx", 0)


def test_empty_and_native(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, source string")
    out = quality_rules(df)
    assert out.count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))
