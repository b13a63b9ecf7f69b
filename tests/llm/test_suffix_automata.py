import hashlib

import pytest

from quillspark.llm.suffix_automata import build_shards, remove_reference_spans
from tests.llm.test_substring_dedup import brute, make


@pytest.mark.parametrize("seed,width", [(1, 10), (2, 10), (3, 50)])
def test_corpus_as_its_own_reference(spark, seed, width):
    rows = make(seed, width)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    shards = build_shards(df, id_col="doc_id", shard_words=400)
    assert len(shards) > 1
    got = remove_reference_spans(df, shards, width=width, earlier_only=True).collect()
    digest = [(r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in got]
    assert sorted(digest, key=str) == brute(rows, width)
    assert all(sum(s.n for s in r.spans) == r.n_removed for r in got)


def test_bound_and_plain_reference(spark):
    ref = spark.createDataFrame([("a b c d e",), (None,)], "text string")
    with pytest.raises(ValueError):
        build_shards(ref, id_col=None, max_words=3)
    shards = build_shards(ref, id_col=None)
    docs = spark.createDataFrame([(1, "x b c d y"), (None, "a b c d e"), (2, None)], "doc_id bigint, text string")
    got = {r.doc_id: r.kept_text for r in remove_reference_spans(docs, shards, width=3).collect()}
    assert got == {1: "x y", None: "", 2: ""}
