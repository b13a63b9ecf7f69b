"""Spans that documents share with a bounded reference, by broadcast suffix automata.

The reference's texts are dealt over shards; each shard is one automaton over words, broadcast to all
tasks. A document is streamed through each shard for its matching statistics: for every word, the state
of the longest stretch ending there that the shard has. Stretches of ``width`` words or more are removed.

The reference has to be bounded: automata are held by every executor and every document passes every
shard. For a corpus compared with itself, see :mod:`quillspark.llm.substring_dedup`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.text import columns_of, word_count

ANY = float("-inf")


class SuffixAutomaton:
    """All stretches of words of some texts; each state knows the least id of the texts that have its stretches."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.least = [-1], [0], [float("inf")]

    def _state(self, size: int, moves: dict[bytes, int], link: int, least: float) -> int:
        self.next.append(moves)
        self.size.append(size)
        self.link.append(link)
        self.least.append(least)
        return len(self.size) - 1

    def _split(self, at: int, word: bytes) -> int:
        """The state of the stretch ``at`` + ``word`` that is no longer than that; divides one that is."""
        to, size = self.next[at][word], self.size[at] + 1
        if self.size[to] == size:
            return to
        twin = self._state(size, dict(self.next[to]), self.link[to], float("inf"))
        self.link[to] = twin
        while at >= 0 and self.next[at].get(word) == to:
            self.next[at][word] = twin
            at = self.link[at]
        return twin

    def add(self, words: list[bytes], text_id: float) -> None:
        at = 0
        for word in words:
            if word in self.next[at]:
                new = self._split(at, word)
            else:
                new = self._state(self.size[at] + 1, {}, 0, float("inf"))
                up = at
                while up >= 0 and word not in self.next[up]:
                    self.next[up][word] = new
                    up = self.link[up]
                self.link[new] = self._split(up, word) if up >= 0 else 0
            self.least[new] = min(self.least[new], text_id)
            at = new

    def finish(self) -> SuffixAutomaton:
        """Hand least ids on to shorter stretches, the longest first."""
        for s in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up = self.link[s]
            self.least[up] = min(self.least[up], self.least[s])
        return self

    def covered(self, words: list[bytes], width: int, before: float) -> np.ndarray:
        """Which words lie in a stretch of ``width`` that a text with an id under ``before`` has."""
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        state, n = 0, 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                n = self.size[state]
            state = self.next[state].get(word, 0)
            n = n + 1 if state else 0
            while state and self.size[self.link[state]] >= width:
                state = self.link[state]
                n = self.size[state]
            if n >= width and self.least[state] < before:
                edge[i + 1 - width] += 1
                edge[i + 1] -= 1
        return np.cumsum(edge[:-1]) > 0


def build_shards(reference: DataFrame, *, id_col: str | None, text_col: str = "text", shard_words: int = 100_000, max_words: int = 2_000_000) -> list[SuffixAutomaton]:
    """Automata of ``reference``, of about ``shard_words`` words each; refuses a reference over ``max_words`` words."""
    total = reference.agg(F.sum(word_count(reference[text_col]))).first()[0] or 0
    if total > max_words:
        raise ValueError(f"the reference has {total} words; at most {max_words} are broadcast")
    shards, room = [], 0
    columns = [reference[text_col].alias("t"), (reference[id_col] if id_col else F.lit(None)).cast("double").alias("i")]
    for r in reference.select(*columns).toLocalIterator():
        words = (r["t"] or "").encode().split()
        if id_col and r["i"] is None:
            continue
        if not shards or room < len(words):
            shards.append(SuffixAutomaton())
            room = shard_words
        shards[-1].add(words, r["i"] if id_col else ANY)
        room -= len(words)
    return [s.finish() for s in shards]


def remove_reference_spans(docs: DataFrame, shards: list[SuffixAutomaton], *, id_col: str = "doc_id", text_col: str = "text", width: int = 50, earlier_only: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, spans (first word, number of words of each that is removed) for every row.

    ``earlier_only``: texts of the reference count only where their id is smaller than the document's. Null texts have
    no words; null ids lose nothing with ``earlier_only``; an empty table gives an empty table.
    """
    columns_of(docs, [id_col, text_col])
    shared = docs.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = (body or b"").split()
                before = float("inf") if not earlier_only else ANY if doc is None else doc
                hidden = np.zeros(len(words), dtype=bool)
                for shard in shared.value:
                    hidden |= shard.covered(words, width, before)
                turn = np.flatnonzero(np.diff(np.concatenate(([0], hidden.astype(np.int8), [0]))))
                kept = b" ".join(w for w, h in zip(words, hidden.tolist(), strict=True) if not h)
                out.append((doc, len(words), int(hidden.sum()), kept.decode(), [{"first": int(a), "n": int(b - a)} for a, b in zip(turn[::2], turn[1::2], strict=True)]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    asked = docs.select(docs[id_col].cast("bigint").alias("doc_id"), F.encode(docs[text_col], "UTF-8").alias("body"))
    return asked.mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_text string, spans array<struct<first:int,n:int>>")
