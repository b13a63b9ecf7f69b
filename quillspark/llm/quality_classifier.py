"""Quality classifier by co-training.

Two classifiers see each document from different sides. The content view has its words: hashed words, how
words end, how they repeat; shares only, so nothing of its length. The page view has its metadata: language, source,
characters, lines, words to a line, characters to a word; sizes only, so no character of its text. In rounds, each scores
all documents without a label and gives those that it is surest of, with its own labels, to the other's training
set. Both are then calibrated on labelled documents kept apart, and a logistic combination of the
calibrated log-odds scores every document.

Views are computed once and written; rounds read them. Only labelled documents are a bounded sample.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.samples import held_out, labelled_ids
from quillspark.llm.text import columns_of
from quillspark.scratch import discard, materialize

PLAIN_ENDS = 64
ENDS = PLAIN_ENDS + 128
WORDS = 32
HASHED = 16
CONTENT = ENDS + WORDS + 5
PAGE = 6 + 2 * HASHED
MEMO = 100_000
PIECE = 1024
_BUCKETS: dict[str, tuple[int, int, bool]] = {}


def _buckets(word: str) -> tuple[int, int, bool]:
    if len(_BUCKETS) > MEMO:
        _BUCKETS.clear()
    end = zlib.crc32(word[-2:].encode())
    # Ends in letters are many and would drown the others in shared buckets.
    end = end % PLAIN_ENDS if word[-1].isalnum() else PLAIN_ENDS + end % (ENDS - PLAIN_ENDS)
    got = _BUCKETS[word] = (end, ENDS + zlib.crc32(word.encode()) % WORDS, word.isupper())
    return got


def content_view(text: str | None) -> np.ndarray:
    """Shares of hashed word ends and words, repetition and upper case; zeros for a text without words."""
    tokens = (text or "").split()
    if not tokens:
        return np.zeros(CONTENT)
    n = len(tokens)
    seen = Counter(tokens)
    known = _BUCKETS
    found = [known[t] if t in known else _buckets(t) for t in seen]
    count = np.fromiter(seen.values(), dtype=float, count=len(seen)) / n
    end, word, upper = zip(*found, strict=True)
    out = np.bincount(end, weights=count, minlength=CONTENT)
    out += np.bincount(word, weights=count, minlength=CONTENT)
    top = np.sort(count)[-5:]
    at = ENDS + WORDS
    out[at:] = (sum(map(str.__eq__, tokens, tokens[1:])) / n, len(seen) / n, top[-1], top.sum(), count[list(upper)].sum())
    return out


def page_view(text: str | None, lang: str | None, source: str | None) -> np.ndarray:
    """Sizes, and language and source (both hashed)."""
    text = text or ""
    lines = text.split("\n")
    words = max(len(text.split()), 1)
    out = np.zeros(PAGE)
    out[:6] = (np.log1p(len(text)), np.log1p(len(lines)), np.log1p(max(map(len, lines))), np.log1p(words), len(text) / words, np.log1p(words / len(lines)))
    out[6 + zlib.crc32((lang or "").encode()) % HASHED] = 1
    out[6 + HASHED + zlib.crc32((source or "").encode()) % HASHED] = 1
    return out


@dataclass
class Views:
    """Documents with both views, written out: rid, id, a, b, and the carried columns as c0, c1, ..."""

    frame: DataFrame
    names: list[str]


def quality_views(docs: DataFrame, carry: list[str] | None = None) -> Views:
    """Both views of every row of ``docs``, with the columns in ``carry`` (default doc_id).

    Null texts, languages and sources count as empty strings. Null ids, repeated rows and extra columns of any name make no difference;
    an empty table gives an empty table.
    """
    columns_of(docs, ["doc_id", "text", "lang", "source"])
    names = ["doc_id"] if carry is None else carry
    asked = docs.select(
        F.monotonically_increasing_id().alias("rid"), docs["doc_id"].alias("id"), *(docs[c].alias(f"c{i}") for i, c in enumerate(names)),
        docs["text"].cast("string").alias("_t"), docs["lang"].cast("string").alias("_l"), docs["source"].cast("string").alias("_s"),
    )
    kept = len(names) + 2
    numbers = T.ArrayType(T.FloatType())
    schema = T.StructType([*asked.schema.fields[:kept], T.StructField("a", numbers), T.StructField("b", numbers)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Few texts at a time are Python objects, however many a batch has.
        for batch in (whole.slice(at, PIECE) for whole in batches for at in range(0, whole.num_rows, PIECE)):
            text, lang, source = (batch.column(kept + i).to_pylist() for i in range(3))
            a = np.concatenate([content_view(t) for t in text]).astype(np.float32)
            b = np.concatenate([page_view(*x) for x in zip(text, lang, source, strict=True)]).astype(np.float32)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * n), pa.array(x)) for x, n in ((a, CONTENT), (b, PAGE))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(kept)), *lists], names=schema.names)

    return Views(materialize(asked.mapInArrow(run, schema), "quality-views"), names)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n).astype(float)


@dataclass
class Logistic:
    """A logistic regression on standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.clip(z @ self.w[1:] + self.w[0], -30, 30)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> Logistic:
    """Newton steps with a ridge; the intercept is free."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack((np.ones(len(x)), np.clip((x - mean) / scale, -8, 8)))
    w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w)


@dataclass
class QualityModel:
    content: Logistic
    page: Logistic
    content_scale: Logistic
    page_scale: Logistic
    join: Logistic
    given: tuple[int, int] = (0, 0)

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality: content view, page view, both."""
        la = self.content_scale.logit(self.content.logit(a)[:, None])
        lb = self.page_scale.logit(self.page.logit(b)[:, None])
        both = self.join.logit(np.column_stack((la, lb)))
        return tuple(1 / (1 + np.exp(-v)) for v in (la, lb, both))


#: Takes both models, for each view the rows it was given already, how many rows of each label to find, and for each
#: view and label the least confidence; returns for each view and label (1, 0) what the other view is surest of: keys and
#: features of the view that gets them.
Surest = Callable[[list[Logistic], list[set[int]], dict[int, int], dict[tuple[int, int], float]], dict[tuple[int, int], tuple[list[int], np.ndarray]]]


def least_confidence(conf: np.ndarray, right: np.ndarray, sure: float, support: int = 20) -> float:
    """The least confidence at or above which a share ``sure`` of labelled rows, and ``support`` of them, are right; 2 if there is none."""
    order = np.argsort(-conf, kind="stable")
    conf, share = conf[order], np.cumsum(right[order]) / np.arange(1, len(conf) + 1)
    last = np.append(conf[1:] != conf[:-1], True)  # rows of equal confidence are in or out together
    at = np.flatnonzero(last & (share >= sure) & (np.arange(1, len(conf) + 1) >= support))
    return float(conf[at[-1]]) if len(at) else 2.0


def co_train(a: np.ndarray, b: np.ndarray, y: np.ndarray, apart: np.ndarray, surest: Surest, *, rounds: int = 5, exchange: int = 300, sure: float = 0.99, support: int = 20) -> QualityModel:
    """``a``, ``b``: the two views of labelled rows, ``y`` their labels, ``apart``: rows for calibration.

    A view gives pseudo-labels only where it is right on a share ``sure`` of the rows kept apart that it is as confident of, so a
    weak view learns from a strong one without spoiling it.
    """
    fit = ~apart
    if len(set(y[fit])) < 2 or len(set(y[apart])) < 2:
        fit = apart = np.ones(len(y), dtype=bool)
    sets, labels = [[a[fit]], [b[fit]]], [[y[fit]], [y[fit]]]
    given: list[set[int]] = [set(), set()]
    models = [fit_logistic(a[fit], y[fit]), fit_logistic(b[fit], y[fit])]
    good = y[fit].mean()
    most = {1: max(1, round(exchange * good)), 0: max(1, round(exchange * (1 - good)))}
    for _ in range(rounds):
        cutoff = {}
        for me, x in ((0, a[apart]), (1, b[apart])):
            p = 1 / (1 + np.exp(-models[me].logit(x)))
            cutoff |= {(me, 1): least_confidence(p, y[apart] == 1, sure, support), (me, 0): least_confidence(1 - p, y[apart] == 0, sure, support)}
        found = surest(models, given, most, cutoff)
        for (other, label), (keys, rows) in sorted(found.items()):
            if keys:
                given[other].update(keys)
                sets[other].append(rows)
                labels[other].append(np.full(len(keys), float(label)))
        if not any(keys for keys, _ in found.values()):
            break
        models = [fit_logistic(np.concatenate(sets[i]), np.concatenate(labels[i])) for i in (0, 1)]
    la, lb = models[0].logit(a[apart])[:, None], models[1].logit(b[apart])[:, None]
    ca, cb = fit_logistic(la, y[apart], 0.01), fit_logistic(lb, y[apart], 0.01)
    join = fit_logistic(np.column_stack((ca.logit(la), cb.logit(lb))), y[apart], 0.1)
    return QualityModel(models[0], models[1], ca, cb, join, (len(given[0]), len(given[1])))


def surest_of(pool: DataFrame) -> Surest:
    """Over all rows of ``pool`` (rid, a, b): every task keeps its own surest rows, of which the surest of all are taken."""
    schema = "other int, label int, rid bigint, conf double, x array<double>"

    def find(models: list[Logistic], given: list[set[int]], most: dict[int, int], cutoff: dict[tuple[int, int], float]) -> dict[tuple[int, int], tuple[list[int], np.ndarray]]:
        gone = [np.array(sorted(g), dtype=np.int64) for g in given]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                rid = batch.column(0).to_numpy()
                views = _matrix(batch.column(1), CONTENT), _matrix(batch.column(2), PAGE)
                for me, other in ((0, 1), (1, 0)):
                    p = 1 / (1 + np.exp(-models[me].logit(views[me])))
                    free = ~np.isin(rid, gone[other])
                    for label, conf in ((1, p), (0, 1 - p)):
                        at = np.flatnonzero(free & (conf >= cutoff[me, label]))
                        now = (conf[at], rid[at], views[other][at])
                        if (other, label) in best:
                            now = tuple(np.concatenate(x) for x in zip(best[other, label], now, strict=True))
                        top = np.lexsort((now[1], -now[0]))[: most[label]]
                        best[other, label] = tuple(x[top] for x in now)
            for (other, label), (conf, rid, x) in best.items():
                if len(rid):
                    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(rid) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))
                    fixed = (pa.array(np.full(len(rid), v, dtype=np.int32)) for v in (other, label))
                    yield pa.RecordBatch.from_arrays([*fixed, pa.array(rid), pa.array(conf), rows], names=["other", "label", "rid", "conf", "x"])

        kept = materialize(pool.select("rid", "a", "b").mapInArrow(run, schema), "surest")
        out = {}
        for other, n in ((0, CONTENT), (1, PAGE)):
            for label in (1, 0):
                top = kept.where((F.col("other") == other) & (F.col("label") == label)).orderBy(F.desc("conf"), "rid").limit(most[label])
                got = top.select("rid", "x").toArrow()
                out[other, label] = (got["rid"].to_pylist(), _matrix(got["x"], n))
        discard(kept)
        return out

    return find


def _undecided() -> QualityModel:
    """Without labels of both kinds every document scores 0.5."""
    flat = lambda n: Logistic(np.zeros(n), np.ones(n), np.zeros(n + 1))
    return QualityModel(flat(CONTENT), flat(PAGE), flat(1), flat(1), flat(2))


def fit_quality(views: Views, labels: DataFrame, *, max_labelled: int = 3000, rounds: int = 5, exchange: int = 300, sure: float = 0.99) -> QualityModel:
    """Co-train on at most ``max_labelled`` documents of each label, chosen by hash, and on all documents without one.

    A round moves at most ``exchange`` pseudo-labels each way, in the labels' proportion; ``sure`` is as in :func:`co_train`. Labels
    other than 0 and 1, null ids and labels without a document are left out; conflicting labels count as 1; of documents with
    one id the first row is learned from. Without labels of both kinds, the model scores 0.5 everywhere.
    """
    ids = labelled_ids(labels, "quality", max_labelled)
    rows = views.frame.join(F.broadcast(ids), views.frame["id"] == ids["doc_id"]).select("id", "y", "rid", "a", "b")
    rows = rows.groupBy("id", "y").agg(F.min_by(F.struct("a", "b"), "rid").alias("v")).select("y", held_out(F.col("id")).alias("apart"), "v.a", "v.b", "id")
    got = rows.orderBy("id").toArrow()
    y = got["y"].to_numpy().astype(float)
    if len(set(y)) < 2:
        return _undecided()
    a, b, apart = _matrix(got["a"], CONTENT), _matrix(got["b"], PAGE), got["apart"].to_numpy(zero_copy_only=False).astype(bool)
    known = labels.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("id")).distinct()
    pool = materialize(views.frame.select("rid", "id", "a", "b").join(known, "id", "left_anti").drop("id"), "unlabelled")
    model = co_train(a, b, y, apart, surest_of(pool), rounds=rounds, exchange=exchange, sure=sure)
    discard(pool)
    return model


def score_quality(views: Views, model: QualityModel, *, threshold: float = 0.5) -> DataFrame:
    """The carried columns, content_score, page_score, score, kept (score >= threshold) for every row, in no order.

    A null or empty text is scored by its page view and by a content view of zeros. Carried columns called like a result hide nothing:
    both are there, so rename one of them before use by name.
    """
    n = len(views.names)
    asked = views.frame.select(*(f"c{i}" for i in range(n)), "a", "b")
    schema = T.StructType([*asked.schema.fields[:n], *(T.StructField(c, T.DoubleType()) for c in ("content_score", "page_score", "score"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = model.scores(_matrix(batch.column(n), CONTENT), _matrix(batch.column(n + 1), PAGE))
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)), *map(pa.array, found)], names=schema.names)

    scored = asked.mapInArrow(run, schema)
    return scored.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(views.names)), "content_score", "page_score", "score", (F.col("score") >= threshold).alias("kept"))


def good_documents(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` that a classifier co-trained on ``labels`` keeps, with their columns, whatever they are called.

    Nulls, ties, repeated rows and empty tables are as in :func:`quality_views` and :func:`fit_quality`; rows that agree in text,
    language and source all stay or all go.
    """
    names = list(docs.columns)
    views = quality_views(docs, names)
    model = fit_quality(views, labels, **options)
    clear = Views(views.frame, [f"d{i}" for i in range(len(names))])
    return score_quality(clear, model, threshold=threshold).where("kept").select(*(F.col(f"d{i}").alias(c) for i, c in enumerate(names)))
