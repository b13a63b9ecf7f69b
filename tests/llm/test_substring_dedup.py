import hashlib
import random

from quillspark.llm.substring_dedup import dedup_substrings


def brute(rows, width):
    first = {}
    split = [(k, (t or "").split()) for k, t in rows]
    for k, w in split:
        for i in range(len(w) - width + 1):
            s = tuple(w[i : i + width])
            if k is not None:
                first[s] = min(first.get(s, k), k)
    out = []
    for k, w in split:
        gone = set()
        for i in range(len(w) - width + 1):
            if k is not None and first[tuple(w[i : i + width])] < k:
                gone.update(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((k, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def make(seed, width):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "c", "dé", "e", "ff"]) if seed % 2 else str(rng.randrange(10_000))
    pool = [[word() for _ in range(rng.randint(width - 2, 3 * width))] for _ in range(6)]
    pool.append(["same"] * 2 * width)
    rows = []
    for k in range(60):
        w = []
        for _ in range(rng.randint(0, 4)):
            w += [word() for _ in range(rng.randint(0, width))]
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            w += p if rng.random() < 0.5 else p[a : a + rng.randint(0, len(p))]
        rows.append((k, " \n".join(w)))
    rng.shuffle(rows)
    return rows + [rows[3], (None, rows[5][1]), (70, rows[5][1]), (71, None), (72, ""), (70, rows[6][1])]


def test_brute_force(spark):
    for seed, width, gram in ((1, 10, 3), (2, 10, 4), (3, 50, 12), (4, 50, 12)):
        rows = make(seed, width)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS doc", "1 AS t")
        got = [tuple(r) for r in dedup_substrings(df, width=width, gram=gram).collect()]
        assert sorted(got, key=str) == brute(rows, width)


def test_texts_and_empty(spark):
    long = " ".join(map(str, range(80)))
    df = spark.createDataFrame([(1, long), (2, "x " + long[:-3] + " y")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in dedup_substrings(df, texts=True).collect()}
    assert got[1].kept_text == long and got[2].kept_text == "x y"
    assert dedup_substrings(df.where("doc_id > 5")).count() == 0


def test_long_repetition_and_text_ids(spark):
    """Runs beyond the longest are cut wherever a document's run begins, which differs between documents."""
    rng = random.Random(5)
    thue = [bin(i).count("1") % 2 for i in range(4096)]
    rows = [
        ("a", "z " * 700 + "end"), ("b", "q " + "z " * 333), ("c", " ".join(["u v"] * 400)), ("d", "u " + "v u " * 250),
        ("e", " ".join("xy"[t] for t in thue[:2048])), ("f", " ".join("yx"[t] for t in thue[:2048])),
        ("g", " ".join(str(rng.randrange(10**6)) for _ in range(50_000))), ("h", "z " * 49),
    ]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = [tuple(r) for r in dedup_substrings(df).collect()]
    assert sorted(got, key=str) == brute(rows, 50)
    none = [tuple(r) for r in dedup_substrings(df.where("doc_id = 'g'")).collect()]
    assert none[0][2] == 0
