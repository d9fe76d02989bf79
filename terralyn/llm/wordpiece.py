"""Operator 6: token counts by a linear longest-match automaton.

A word, written with a space in front, is matched from the left by the longest entry of a byte-level vocabulary, again
and again. A trie of the vocabulary carries failure links: where no entry goes on, the link leads to the state after
popping the entries that are certain by then, and the number of popped entries is stored with it. Each byte is read
once and no piece is built, so a word costs time in proportion to its bytes whatever the vocabulary.

Cases: a null or empty text has no words and no tokens; every byte is an entry, so no word is unknown; equal rows are
all returned.
"""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import batches_of_texts

#: Counts of words that a worker remembers before it starts afresh.
MEMO_LIMIT = 500_000


class Automaton:
    """Transitions of the trie, and for each state its failure link and the pieces popped on the way."""

    def __init__(self, vocabulary):
        entries = sorted(set(vocabulary))
        if missing := {bytes([b]) for b in range(256)} - set(entries):
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.go: dict[int, int] = {}
        final, by_depth = [False], []
        for entry in entries:
            at = 0
            for depth, byte in enumerate(entry):
                key = at << 8 | byte
                if key not in self.go:
                    self.go[key] = len(final)
                    final.append(False)
                    while len(by_depth) <= depth:
                        by_depth.append([])
                    by_depth[depth].append((at, byte, self.go[key]))
                at = self.go[key]
            final[at] = True
        self.link, self.popped = [-1] * len(final), [0] * len(final)
        for level in by_depth:  # a state's parent is complete before it
            for parent, byte, state in level:
                if final[state]:
                    self.link[state], self.popped[state] = 0, 1
                    continue
                at, n = self.link[parent], self.popped[parent]
                while (at << 8 | byte) not in self.go:
                    n += self.popped[at]
                    at = self.link[at]
                self.link[state], self.popped[state] = self.go[at << 8 | byte], n

    def count(self, word: bytes) -> int:
        go, link, popped, at, n = self.go, self.link, self.popped, 0, 0
        for byte in word:
            while (to := go.get(at << 8 | byte)) is None:
                n += popped[at]
                at = link[at]
            at = to
        while at:
            n += popped[at]
            at = link[at]
        return n


class _Counts(dict):
    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO_LIMIT:
            self.clear()
        n = self[word] = self.automaton.count(b" " + word)
        return n


@functools.lru_cache(maxsize=2)
def counts(path: str) -> _Counts:
    with open(path, "rb") as lines:
        return _Counts(Automaton(base64.b64decode(x.split()[0]) for x in lines if x.strip()))


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of each whole text; words are runs of bytes other than space and ASCII 9 to 13."""

    def run(batches):
        work = counts(path)
        for batch in batches:
            for i, texts in batches_of_texts(batch, "text"):
                words = [t.encode().split() for t in texts]  # bytes.split knows just those six kinds of white space
                tokens = [sum(map(work.__getitem__, w)) for w in words]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, len(texts)), pa.array(np.array([len(w) for w in words], np.int64)), pa.array(np.array(tokens, np.int64))], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")
