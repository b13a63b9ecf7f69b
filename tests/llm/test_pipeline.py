import importlib

import corpus_pipeline
import __spark_entry__
from tests.llm.test_classifiers import corpus


def test_stages_and_guard(spark, tmp_path):
    docs, labels = corpus(300, 5)
    good = [d for d, l in zip(docs, labels) if l[1]]
    bad = {d[0] for d, l in zip(docs, labels) if not l[1]}
    item = " ".join("bench%d" % i for i in range(30))
    extra = [(1000 + i, good[0][1], "en", "s0") for i in range(5)] + [(2000, good[1][1] + item, "en", "s1")]
    sf = str(tmp_path)
    spark.createDataFrame([(*d, len(d[1])) for d in docs + extra], "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    df = spark.read.parquet(f"{sf}/documents.parquet")
    names = df.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id for r in df.select("doc_id").collect()}
        df = corpus_pipeline.materialize(stage(spark, df, sf), "t")
        after = {r.doc_id for r in df.select("doc_id").collect()}
        assert after <= before
        assert df.columns == names + (["shard", "slot"] if name == "sharding" else [])
        if name == "quality classifier":
            assert len(after & bad) <= 0.1 * len(bad) and len(before - after - bad) <= 3
        if name == "near-dedup":
            assert len(after & {good[0][0], *range(1000, 1005)}) <= 1
        if name == "decontamination":
            assert before - after == {2000} & before
    assert corpus_pipeline.run(spark, sf).columns == names + ["shard", "slot"]
    assert "pipeline" in __spark_entry__.queries()


def write(spark, sf, docs, labels, items, more=()):
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", *more).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")


CLASHING = ["1 AS rid", "'a' AS key", "2 AS fp", "3 AS c0", "4 AS d0", "'t' AS _t", "5 AS _copies", "6 AS kept", "7 AS size", "8 AS score", "9 AS row_key", "10 AS h"]


def test_nulls_ties_repeats_long_texts_and_clashing_columns(spark, tmp_path):
    docs, labels = corpus(250, 6)
    rows = [(*d, len(d[1])) for d in docs]
    good = next(d for d, l in zip(docs, labels) if l[1])
    long = " ".join("w%d" % (i * 7919 % 100_003) for i in range(60_000))
    rows += [(None, None, None, None, None), (901, None, "en", "s0", 0), (902, "", "en", None, 0), (903, " \n\t ", None, "s1", 5), (904, long, "en", "s1", len(long))]
    rows += [(906, good[1] * 400, "en", "s1", 1)]
    rows += [rows[0]] * 3 + [(None, good[1], "en", "s0", 5), (905, good[1], "en", "s0", 5)]
    write(spark, str(tmp_path), rows, labels, [(1, long[:300]), (2, None), (None, "x y z")], CLASHING)
    df = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, counts = df.columns, []
    for name, stage in corpus_pipeline.STAGES:
        df = corpus_pipeline.materialize(stage(spark, df, str(tmp_path)), "t")
        assert df.columns == names + (["shard", "slot"] if name == "sharding" else [])
        counts.append(df.count())
        if name == "near-dedup":
            assert df.groupBy("text").count().where("count > 1").count() == 0
            blank = df.where("text IS NULL OR trim(replace(replace(text, '\n', ''), '\t', '')) = ''")
            assert blank.count() <= 1
        if name == "decontamination":
            assert df.where("doc_id = 904").count() == 0
    assert counts[1] < counts[0] <= len(rows) and counts[2] <= counts[1] and counts[4] == counts[3]
    again = corpus_pipeline.run(spark, str(tmp_path))
    key = ["doc_id", "text", "shard"]
    assert sorted(map(tuple, again.select(key).collect()), key=str) == sorted(map(tuple, df.select(key).collect()), key=str)


def test_empty_tables(spark, tmp_path):
    docs, labels = corpus(60, 7)
    for at, (d, l, b) in enumerate([([], labels, [(1, "a b c d e f")]), ([(*x, 1) for x in docs], [], []), ([], [], [])]):
        sf = f"{tmp_path}/{at}"
        write(spark, sf, d, l, b)
        out = corpus_pipeline.run(spark, sf)
        assert out.columns[-2:] == ["shard", "slot"] and (out.count() > 0) == bool(d)


def test_intermediate_tables_go(spark, tmp_path):
    from quillspark import scratch

    docs, labels = corpus(60, 8)
    write(spark, str(tmp_path), [(*x, 1) for x in docs], labels, [(1, "a b c d e f")])
    before = scratch.tables()
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert scratch.tables() - before == {out._quillspark_path}


def test_ops_are_registered():
    importlib.reload(__spark_entry__)
    found = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in found) for i in range(1, 11))
