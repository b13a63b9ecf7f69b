import math
import random
import re
import zlib

import numpy as np

from quillspark.llm import quality_classifier as qc
from quillspark.llm import toxicity as tox


def corpus(n=700, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(n):
        toxic, bad = rng.random() < 0.2, rng.random() < 0.25
        sents = [" ".join(word() for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(2, 15))]
        if toxic:
            for _ in range(rng.randint(1, 3)):
                j = rng.randrange(len(sents))
                sents[j] += " " + rng.choice(["zgrunk", "zgrunked", "zgrunkly", "vloop", "vloopish"])
        text = ". ".join(sents) + ".\n"
        if bad:
            text = rng.choice([" | ".join(text.split()), "!! ".join(text.upper().split()), " ".join([word()] * 200)])
        docs.append((i, text, rng.choice(["en", "de"]), rng.choice(["s0", "s0", "s1"])))
        labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def frames(spark):
    docs, labels = corpus()
    d = spark.createDataFrame(docs + [(900, None, None, None), (901, "", "en", None), (None, "some words", "en", "s0"), (0, docs[0][1], "en", "s0")], "doc_id bigint, text string, lang string, source string")
    extra = [(1, None, None), (None, 1, 1), (5000, 1, 1)]
    return d.selectExpr("*", "1 AS score", "'x' AS y", "2 AS apart"), spark.createDataFrame(labels + extra, "doc_id bigint, quality int, toxic int")


def test_toxicity_held_out(spark):
    d, l = frames(spark)
    model = tox.fit_toxicity(d, l)
    got = tox.score_toxicity(d, model).toPandas()
    assert len(got) == d.count() and got.score.between(0, 1).all()
    truth = {r.doc_id: r.toxic for r in l.where("doc_id < 700 AND toxic IS NOT NULL").collect()}
    known = got[got.doc_id.isin(list(truth))]
    assert all(h == (zlib.crc32(str(int(k)).encode()) % 5 == 0) for k, h in zip(known.doc_id, known.held_out))
    out = known[known.held_out]
    assert np.mean([truth[int(k)] == p for k, p in zip(out.doc_id, out.predicted)]) > 0.95
    empty = got[got.doc_id.isin([900, 901])]
    assert len(empty) == 2 and (empty.predicted == 0).all() and not got[got.doc_id.isna()].held_out.any()
    found = tox.offending_sentences(d, model).toPandas()
    assert len(found) and found.sentence.str.contains("zgrunk|vloop").mean() > 0.9


def test_noisy_or():
    m = tox.ToxicityModel({"bad": 3.0, "bad-": 1.0}, -2.0)
    p = [1 / (1 + np.exp(2.0)), 1 / (1 + np.exp(-2.0))]
    assert abs(m.score("fine day. BAD badly! \n") - (1 - (1 - p[0]) * (1 - p[1]))) < 1e-9
    assert m.score(None) == m.score("") == m.score(" . ") == 0


def test_training_data_of_one_kind():
    assert tox.train([("a b", 0), ("c", 0)]).score("a b") < 0.5 and tox.train([]).score("x") < 0.5


def test_quality(spark):
    d, l = frames(spark)
    views = qc.quality_views(d)
    model = qc.fit_quality(views, l)
    got = qc.score_quality(views, model).toPandas()
    assert len(got) == d.count()
    truth = {r.doc_id: r.quality for r in l.where("doc_id < 700 AND quality IS NOT NULL").collect()}
    known = got[got.doc_id.isin(list(truth))]
    assert np.mean([truth[int(k)] == v for k, v in zip(known.doc_id, known.kept)]) > 0.97
    kept = qc.good_documents(d, l)
    assert kept.columns == d.columns and kept.count() == got.kept.sum()


def test_views_share_nothing():
    rng = random.Random(3)
    for _ in range(50):
        words = ["".join(rng.choice("abcXYZ$!é") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(1, 60))]
        text = " ".join(words)
        long = "\n".join([text] * 3)
        assert np.allclose(qc.content_view(text)[: qc.ENDS + qc.WORDS], qc.content_view(long)[: qc.ENDS + qc.WORDS])
        other = "".join(rng.choice("qrst") if c not in " \n" else c for c in long)
        assert np.allclose(qc.page_view(long, "en", "s"), qc.page_view(other, "en", "s"))
    seen = qc.content_view("B!! a B!!")
    assert seen[: qc.ENDS].sum() == 1 and seen[qc.ENDS : qc.ENDS + qc.WORDS].sum() == 1 and seen[-1] == 2 / 3 and not qc.content_view(None).any()


def test_quality_without_labels_or_rows(spark):
    d, l = frames(spark)
    views = qc.quality_views(d.limit(5))
    got = qc.score_quality(views, qc.fit_quality(views, l.where("quality = 1"))).toPandas()
    assert (got.score == 0.5).all() and got.kept.all()
    none = d.where("doc_id < -1")
    assert qc.score_quality(qc.quality_views(none), qc.fit_quality(qc.quality_views(none), l)).count() == 0
    assert qc.good_documents(none, l).count() == 0 and qc.good_documents(d, l.where("false")).count() == d.count()


def test_text_ids_and_clashing_columns(spark):
    docs, labels = corpus(300, 4)
    d = spark.createDataFrame([(f"n{i}", *x) for i, *x in docs], "doc_id string, text string, lang string, source string")
    d = d.selectExpr("*", "1 AS c0", "2 AS rid", "3 AS a", "4 AS kept", "5 AS score", "6 AS id")
    l = spark.createDataFrame([(f"n{i}", q, t) for i, q, t in labels], "doc_id string, quality int, toxic int")
    kept = qc.good_documents(d, l)
    assert kept.dtypes == d.dtypes
    bad = {f"n{i}" for i, q, _ in labels if not q}
    got = {r.doc_id for r in kept.collect()}
    assert len(got & bad) <= 0.1 * len(bad) and len(got) > 0.6 * len(docs)
    found = tox.score_toxicity(d, tox.fit_toxicity(d, l))
    assert found.schema["doc_id"].dataType.simpleString() == "string" and found.count() == len(docs)


def test_rounds_take_the_surest_of_all_rows(spark):
    rng = np.random.default_rng(2)
    n = 5000
    y = (rng.random(n) < 0.5).astype(float)
    a, b = rng.normal(size=(n, qc.CONTENT)), rng.normal(size=(n, qc.PAGE))
    a[:, 0] += 4 * y
    b[:, 0] += 4 * y
    models = [qc.fit_logistic(a[:500], y[:500]), qc.fit_logistic(b[:500], y[:500])]
    pool = spark.createDataFrame([(i, a[i].tolist(), b[i].tolist()) for i in range(n)], "rid bigint, a array<float>, b array<float>").repartition(7)
    given = [set(range(0, n, 2)), set()]
    cut = {(me, label): 0.6 + 0.1 * label for me in (0, 1) for label in (0, 1)}
    got = qc.surest_of(pool)(models, given, {1: 40, 0: 25}, cut)
    a32, b32 = a.astype(np.float32).astype(float), b.astype(np.float32).astype(float)
    for me, view, other in ((0, a32, 1), (1, b32, 0)):
        p = 1 / (1 + np.exp(-models[me].logit(view)))
        for label, conf, k in ((1, p, 40), (0, 1 - p, 25)):
            free = [i for i in range(n) if i not in given[other] and conf[i] >= cut[me, label]]
            want = sorted(free, key=lambda i: (-conf[i], i))[:k]
            keys, rows = got[other, label]
            assert sorted(keys) == sorted(want) and np.allclose(rows, (a32, b32)[other][keys])


def test_least_confidence():
    conf, right = np.array([0.9, 0.8, 0.8, 0.7, 0.6]), np.array([True, True, False, True, False])
    assert qc.least_confidence(conf, right, 0.9, 1) == 0.9 and qc.least_confidence(conf, right, 0.7, 1) == 0.7
    assert qc.least_confidence(conf, right, 0.9, 2) == 2.0 and qc.least_confidence(conf, right, 0.6, 1) == 0.6


def test_exchange_helps_the_weak_view():
    rng = np.random.default_rng(1)
    y = (rng.random(4000) < 0.7).astype(float)
    a = np.column_stack([y + rng.normal(0, 0.4, 4000), rng.normal(size=(4000, 3))])
    b = np.column_stack([y + rng.normal(0, 0.5, 4000), rng.normal(size=(4000, 3))])
    fit, ua, ub = slice(0, 60), a[60:], b[60:]

    def surest(models, given, most, cutoff):
        out = {}
        for me, other in ((0, 1), (1, 0)):
            p = 1 / (1 + np.exp(-models[me].logit((ua, ub)[me])))
            for label, conf in ((1, p), (0, 1 - p)):
                at = [i for i in np.argsort(-conf, kind="stable") if conf[i] >= cutoff[me, label] and i not in given[other]][: most[label]]
                out[other, label] = (at, (ua, ub)[other][at])
        return out

    model = qc.co_train(a[fit], b[fit], y[fit], np.arange(60) >= 40, surest, sure=0.9, support=5)
    _, _, both = model.scores(ua, ub)
    assert ((both >= 0.5) == (y[60:] == 1)).mean() > 0.93 and min(model.given) > 300


def slow_score(model, text):
    """Noisy-or in plain loops."""
    none = 1.0
    for piece in re.split(r"[.!?\n]", (text or "").lower()):
        if not piece.strip():
            continue
        z = model.bias
        for word in set(re.findall(r"\w+", piece)):
            z += model.weights.get(word, 0.0)
            z += sum(model.weights.get(word[:n] + "-", 0.0) for n in range(3, 9) if n < len(word))
        none *= 1 - 1 / (1 + math.exp(-max(min(z, 500), -500)))
    return 1 - none


def test_toxicity_against_plain_loops(spark):
    d, l = frames(spark)
    long = " ".join("w%d zgrunk." % (i % 900) if i % 5000 == 0 else "w%d" % (i % 900) for i in range(60_000))
    more = spark.createDataFrame([(950, long, "en", "s0"), (951, "a.b!c?\n\n. ", "en", "s0"), (951, "a.b!c?\n\n. ", "en", "s0")], "doc_id bigint, text string, lang string, source string")
    d = d.unionByName(more.selectExpr("*", "1 AS score", "'x' AS y", "2 AS apart"))
    model = tox.fit_toxicity(d, l)
    got = tox.score_toxicity(d, model).select("doc_id", "score").collect()
    want = [(r.doc_id, slow_score(model, r.text)) for r in d.select("doc_id", "text").collect()]
    key = lambda x: (str(x[0]), round(x[1], 7))
    assert len(got) == len(want) and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-7 for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)))
    assert model.score(long) > 0.9


def test_toxicity_of_empty_tables(spark):
    d, l = frames(spark)
    none = d.where("doc_id < -1")
    model = tox.fit_toxicity(d, l)
    assert tox.score_toxicity(none, model).count() == 0 and tox.offending_sentences(none, model).count() == 0
    blank = tox.fit_toxicity(none, l)
    assert tox.score_toxicity(d, blank).where("predicted = 1").count() == 0
    assert tox.fit_toxicity(d, l.where("false")).weights == {}


def test_training_lowers_the_noisy_or_loss():
    docs, labels = corpus(250, 9)
    rows = [(t, x[2]) for (_, t, _, _), x in zip(docs, labels)]

    def loss(model):
        p = [min(max(slow_score(model, t), 1e-12), 1 - 1e-12) for t, _ in rows]
        return -sum(math.log(q if y else 1 - q) for q, (_, y) in zip(p, rows)) / len(rows)

    few, many = tox.train(rows, steps=5), tox.train(rows, steps=300)
    assert loss(many) < 0.5 * loss(few) and loss(many) < 0.2


def slow_quality(model, text, lang, source):
    """Both views and the three logistic steps in plain loops."""
    def logit(m, x):
        z = m.w[0] + sum(w * max(-8.0, min(8.0, (v - a) / s)) for w, v, a, s in zip(m.w[1:], x, m.mean, m.scale))
        return max(-30.0, min(30.0, z))

    words = (text or "").split()
    a = [0.0] * qc.CONTENT
    for w in words:
        end = zlib.crc32(w[-2:].encode())
        a[end % qc.PLAIN_ENDS if w[-1].isalnum() else qc.PLAIN_ENDS + end % (qc.ENDS - qc.PLAIN_ENDS)] += 1 / len(words)
        a[qc.ENDS + zlib.crc32(w.encode()) % qc.WORDS] += 1 / len(words)
    if words:
        counts = sorted((words.count(w) / len(words) for w in set(words)), reverse=True)
        a[-5:] = [sum(x == y for x, y in zip(words, words[1:])) / len(words), len(counts) / len(words), counts[0], sum(counts[:5]), sum(w.isupper() for w in words) / len(words)]
    t = text or ""
    lines, n = t.split("\n"), max(len(words), 1)
    b = [math.log1p(len(t)), math.log1p(len(lines)), math.log1p(max(map(len, lines))), math.log1p(n), len(t) / n, math.log1p(n / len(lines))] + [0.0] * (2 * qc.HASHED)
    b[6 + zlib.crc32((lang or "").encode()) % qc.HASHED] = 1.0
    b[6 + qc.HASHED + zlib.crc32((source or "").encode()) % qc.HASHED] = 1.0
    la, lb = logit(model.content_scale, [logit(model.content, a)]), logit(model.page_scale, [logit(model.page, b)])
    return [1 / (1 + math.exp(-z)) for z in (la, lb, logit(model.join, [la, lb]))]


def test_quality_scores_against_plain_loops(spark):
    d, l = frames(spark)
    views = qc.quality_views(d, ["text", "lang", "source"])
    model = qc.fit_quality(views, l)
    rows = qc.score_quality(views, model).collect()
    assert len(rows) == d.count()
    for r in rows:
        want = slow_quality(model, r.text, r.lang, r.source)
        assert max(abs(x - y) for x, y in zip((r.content_score, r.page_score, r.score), want)) < 2e-3
