import random

import duckdb
from xxhash import xxh64_intdigest

from quillspark.llm import simhash_sql
from quillspark.llm.simhash_dedup import simhash_groups


def test_hash():
    rng = random.Random(1)
    texts = list({"".join(rng.choice("abc é😀") for _ in range(n)) for n in range(120)})
    con = duckdb.connect()
    con.execute("CREATE TABLE u(s VARCHAR)")
    con.executemany("INSERT INTO u VALUES (?)", [(t,) for t in texts])
    got = dict(con.execute(f"WITH {', '.join(simhash_sql._hash_steps('u'))} SELECT s, h FROM x").fetchall())
    assert got == {t: xxh64_intdigest(t.encode(), 42) for t in texts}


def test_groups(spark):
    rng = random.Random(2)
    word = lambda: rng.choice(["Ab", "ab", "É", "é", "x1", "long-word", "😀"])
    texts = [" ".join(word() for _ in range(rng.choice([0, 1, 3, 4, 5, 40]))) for _ in range(60)]
    texts += [t + " more" for t in texts[:10]] + [None, "", " \n", texts[20].upper()]
    rows = [(i if i % 9 else None, t) for i, t in enumerate(texts)]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = [tuple(r) for r in simhash_groups(df).collect()]
    want = con.execute(simhash_sql.simhash_sql()).fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
