"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is logistic in its words and their beginnings;
the document's is the noisy-or of its sentences, 1 - prod(1 - p). Only documents are labelled: the
likelihood of their labels under the noisy-or trains the sentence model, which then also says which
sentences offend.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.samples import held_out, labelled_ids, texts_of
from quillspark.llm.text import columns_of

SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"\w+")
MEMO = 300_000


def sentences(text: str | None) -> list[str]:
    """Pieces between full stops, exclamation and question marks and line ends, in lower case, without blank ones."""
    return [s for s in SENTENCE.findall((text or "").lower()) if not s.isspace()]


def features(word: str) -> list[str]:
    """The word and its beginnings, which carry compounds and inflections that training has not seen."""
    return [word, *(word[:n] + "-" for n in range(3, min(len(word), 9)))]


@dataclass
class ToxicityModel:
    """Feature weights and a bias; a sentence adds up its distinct words' weights."""

    weights: dict[str, float]
    bias: float

    def __post_init__(self) -> None:
        self._words: dict[str, float] = {}

    def _word(self, word: str) -> float:
        if len(self._words) > MEMO:
            self._words.clear()
        got = self._words[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return got

    def sentence_scores(self, pieces: list[str]) -> np.ndarray:
        words, other = self._words, self._word
        z = np.empty(len(pieces))
        for i, s in enumerate(pieces):
            z[i] = self.bias + sum([words[w] if w in words else other(w) for w in sorted(set(TOKEN.findall(s)))])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    def score(self, text: str | None) -> float:
        """Noisy-or over the sentences; 0 for a text without any."""
        p = self.sentence_scores(sentences(text))
        return float(-np.expm1(np.log1p(-np.minimum(p, 1 - 1e-12)).sum()))


@dataclass
class Bags:
    """Sentences as distinct word numbers, end to end, so that a sample takes few bytes a word."""

    vocabulary: list[str]
    words: np.ndarray
    sentence_of: np.ndarray
    bag_of: np.ndarray
    y: np.ndarray
    first_seen: np.ndarray


def encode(rows: Iterable[tuple[str | None, int]]) -> Bags:
    """Bags of (text, label) rows; texts without sentences are left out. Rows are read once and not kept."""
    known: dict[str, int] = {}
    words, sizes, bag_of, y, first = array("i"), array("i"), array("i"), [], bytearray()
    seen: set[int] = set()
    for text, label in rows:
        pieces = sentences(text)
        for s in pieces:
            ids = sorted(known.setdefault(w, len(known)) for w in sorted(set(TOKEN.findall(s))))
            words.extend(ids)
            sizes.append(len(ids))
            bag_of.append(len(y))
            key = hash((label, *ids))
            first.append(key not in seen)
            seen.add(key)
        if pieces:
            y.append(float(label))
    n = np.array(sizes, dtype=np.int64)
    return Bags(list(known), np.array(words, dtype=np.int64), np.repeat(np.arange(len(n)), n), np.array(bag_of, dtype=np.int64), np.array(y), np.frombuffer(bytes(first), dtype=np.uint8).astype(bool))


def telling_features(bags: Bags, least: int = 4, evidence: float = 25.0) -> list[str]:
    """All features that toxic documents' distinct sentences have more often than others, by a likelihood ratio.

    Counting distinct sentences keeps copies of a document from counting more than once. The bound on labelled documents
    bounds the features.
    """
    counted = bags.first_seen[bags.sentence_of]
    toxic = bags.y[bags.bag_of[bags.sentence_of]] == 1
    size = len(bags.vocabulary)
    sides = [np.bincount(bags.words[counted & (toxic == v)], minlength=size) for v in (False, True)]
    rate = sides[1].sum() / max(1, sides[0].sum() + sides[1].sum())
    neg, pos = Counter(), Counter()
    for word, n, k in zip(bags.vocabulary, *(x.tolist() for x in sides), strict=True):
        for f in features(word):
            neg[f] += n
            pos[f] += k
    found = []
    for f, k in pos.items():
        n = k + neg[f]
        if k >= least and k > n * rate:
            ratio = 2 * (k * np.log(k / (n * rate)) + (neg[f] * np.log(neg[f] / (n * (1 - rate))) if neg[f] else 0.0))
            if ratio >= evidence:
                found.append((-ratio, f))
    return [f for _, f in sorted(found)]


def train(rows: Iterable[tuple[str | None, int]], *, steps: int = 300, rate: float = 0.1, decay: float = 1e-3) -> ToxicityModel:
    """Fit by Adam over all bags at once, from zero weights on the telling features."""
    bags = encode(rows)
    y, bag_of = bags.y, bags.bag_of
    if len(set(y.tolist())) < 2:
        return ToxicityModel({}, -20.0)
    names = telling_features(bags)
    index = {f: i for i, f in enumerate(names)}
    of_word = [[index[f] for f in features(w) if f in index] for w in bags.vocabulary]
    n = np.array([len(x) for x in of_word], dtype=np.int64)
    begin, flat = np.cumsum(n) - n, np.array([i for x in of_word for i in x], dtype=np.int64)
    some = n[bags.words] > 0
    words, of = bags.words[some], bags.sentence_of[some]
    k = n[words]
    col = flat[np.repeat(begin[words], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
    of = np.repeat(of, k)
    w, bias = np.zeros(len(names)), -6.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = bias + np.bincount(of, weights=w[col], minlength=len(bag_of))
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        none = np.exp(np.maximum(-np.bincount(bag_of, weights=np.logaddexp(0, z), minlength=len(y)), -700))
        push = np.where(y == 1, -none / np.maximum(1 - none, 1e-9), 1.0)
        dz = p * push[bag_of] / len(y)
        g = np.bincount(col, weights=dz[of], minlength=len(w)) + decay * w / max(1, len(w))
        gb = dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / (1 + 2 * t / steps) * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w -= step * m / (np.sqrt(v) + 1e-7)
        bias -= step * mb / (np.sqrt(vb) + 1e-7)
    return ToxicityModel({f: float(w[i]) for f, i in index.items()}, float(bias))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 3000, label_col: str = "toxic") -> ToxicityModel:
    """Train on at most ``max_labelled`` documents of each label, none of them held out.

    Labels other than 0 and 1, null ids and labels without a document are left out; conflicting labels count as 1; of documents
    with one id the least text is learned from; null texts teach nothing. Without labels of both kinds every text scores nearly 0.
    Documents come to the driver one at a time, and only the numbers of their words stay.
    """
    columns_of(docs, ["doc_id", "text"])
    ids = labelled_ids(labels, label_col, max_labelled, ~held_out(F.col("doc_id")))
    rows = texts_of(docs, ids, ["text"]).select("doc_id", "y", "text").orderBy("doc_id").toLocalIterator()
    return train((r["text"], r["y"]) for r in rows)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, from its whole text.

    A null or empty text scores 0. Null ids are scored like others and are not held out; repeated rows
    each get a row; extra columns are ignored.
    """
    columns_of(docs, ["doc_id", "text"])
    asked = docs.select(docs["doc_id"], held_out(docs["doc_id"]).alias("held_out"), docs["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([model.score(t.as_py()) for t in batch.column(2)], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), scores], names=["doc_id", "held_out", "score"])

    scored = asked.mapInArrow(run, f"doc_id {asked.schema[0].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def offending_sentences(docs: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """doc_id, ordinal, sentence (lower case), score of every sentence at or above ``threshold``.

    Null and empty texts have no sentences. Repeated rows each give theirs; null ids stay null; equal sentences of
    a document are told apart by ordinal. An empty table gives an empty table; extra columns are ignored.
    """
    columns_of(docs, ["doc_id", "text"])
    asked = docs.select(docs["doc_id"], docs["text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, ordinal, said, score = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                pieces = sentences(text)
                p = model.sentence_scores(pieces)
                for j in np.flatnonzero(p >= threshold).tolist():
                    row.append(i)
                    ordinal.append(j)
                    said.append(pieces[j].strip())
                    score.append(float(p[j]))
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(ordinal, pa.int32()), pa.array(said, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "ordinal", "sentence", "score"])

    return asked.mapInArrow(run, f"doc_id {asked.schema[0].dataType.simpleString()}, ordinal int, sentence string, score double")
